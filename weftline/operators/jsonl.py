"""JSONL rows: requests, results of every endpoint, usage. One parse of each line, then paths of a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, parsed_json, trim_all


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def kind_at(v: Column, path: str) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID (a JSON null) or null (absent)."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def truthy(v: Column, path: str) -> Column:
    """Present and none of null, false, 0 and the empty string: by its JSON text, which is made once."""
    shown = F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("null"))
    return ~shown.rlike(r'\A(?:null|false|""|-?0(?:\.0*)?(?:[eE].*)?)\z')


def read_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines that are not blank, with their parsed variant (null if malformed)."""
    return df.where(~is_blank(F.col(line_col))).withColumn("v", parsed_json(F.col(line_col)))


def parse_request(df: DataFrame) -> DataFrame:
    """Rows that are requests: an id, no response, no error without a body, and a body that is an object."""
    v = F.col("v")
    ok = truthy(v, "$.custom_id") & ~truthy(v, "$.response") & ~(truthy(v, "$.error") & ~truthy(v, "$.body")) & F.coalesce(kind_at(v, "$.body").startswith("OBJECT"), F.lit(False))
    return df.where(ok).select("*", text_at(v, "$.custom_id").alias("custom_id"), F.coalesce(text_at(v, "$.method"), F.lit("POST")).alias("method"), F.coalesce(text_at(v, "$.url"), F.lit("")).alias("url"))


def is_jsonl_row(v: Column) -> Column:
    """An object with one of the keys of a request or a result."""
    keys = F.array(*[kind_at(v, f"$.{k}").isNotNull() for k in ("custom_id", "response", "error", "body")])
    return F.coalesce(F.exists(keys, lambda x: x), F.lit(False))


BODY = "$.response.body"


def _finish(v: Column) -> Column:
    return text_at(v, BODY + ".choices[0].finish_reason")


def _stopped(v: Column) -> Column:
    """The reason of an incomplete response, else null."""
    return F.when(text_at(v, BODY + ".status") == "incomplete", F.coalesce(text_at(v, BODY + ".incomplete_details.reason"), F.lit("")))


def result_code(v: Column, missing_status_fails: bool = False) -> Column:
    """Why a result line is a failure, null if it is none. Readers of results let a missing status pass; the statistics do not."""
    status = text_at(v, "$.response.status_code")
    wrong = status.isNotNull() & (status != "200")
    finish, stopped = _finish(v), _stopped(v)
    return (
        F.when(v.isNull(), "malformed").when(truthy(v, "$.error"), "error").when(~truthy(v, "$.response"), "unrecognized")
        .when((status.isNull() | wrong) if missing_status_fails else wrong, "status").when(truthy(v, BODY + ".error"), "error")
        .when(finish == "error", "stream_terminated").when(finish == "length", "max_tokens").when(finish == "content_filter", "content_filter")
        .when(stopped.isin("max_output_tokens", "max_tokens"), "max_tokens").when(stopped == "content_filter", "content_filter").when(stopped.isin("failed", "cancelled"), "execution_incomplete")
    )


_OUTPUT = "array<struct<type:string,content:array<struct<type:string,text:string>>>>"
_DETAILS = "array<struct<type:string,text:string>>"


def _output_text(v: Column, item: str, part: str | None) -> Column:
    """Texts of the parts of output items of one type, joined."""
    items = F.filter(F.try_variant_get(v, BODY + ".output", _OUTPUT), lambda x: x["type"] == item)
    parts = F.flatten(F.transform(items, lambda x: F.coalesce(x["content"], F.array().cast(_DETAILS))))
    return F.array_join(F.transform(parts if part is None else F.filter(parts, lambda p: p["type"] == part), lambda p: p["text"]), "")


def _json_text(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)


def as_result(raw: Column, custom_id: Column) -> Column:
    """An answer that came whole, not as a stream, as the variant of a result line, so that the same checks and readers apply; null if malformed."""
    line = F.concat(F.lit('{"custom_id":'), _json_text(custom_id), F.lit(',"response":{"status_code":200,"body":'), raw, F.lit("}}"))
    return F.when(parsed_json(raw).isNotNull(), F.try_parse_json(line))


def parse_results(df: DataFrame, router: bool = False) -> DataFrame:
    """custom_id, is_error, error_code, text and reasoning of each result line; the router's form also has reasoning in two more places."""
    v = F.col("v")
    choice = BODY + ".choices[0]"
    has_output, has_message = truthy(v, BODY + ".output"), truthy(v, choice + ".message")
    has_text = kind_at(v, choice + ".text").isNotNull()
    code = F.coalesce(result_code(v), F.when(~has_output & ~has_message & ~has_text, "unrecognized"))
    text = F.when(has_output, _output_text(v, "message", "output_text")).when(has_message, F.coalesce(text_at(v, choice + ".message.content"), F.lit(""))).otherwise(text_at(v, choice + ".text"))
    thought = F.nullif(text_at(v, choice + ".message.reasoning_content"), F.lit(""))
    if router:
        details = F.filter(F.try_variant_get(v, choice + ".message.reasoning_details", _DETAILS), lambda d: d["type"] == "reasoning.text")
        thought = F.coalesce(thought, F.nullif(text_at(v, choice + ".message.reasoning"), F.lit("")), F.nullif(F.array_join(F.transform(details, lambda d: d["text"]), ""), F.lit("")))
    reasoning = F.when(has_output, F.nullif(_output_text(v, "reasoning", None), F.lit(""))).when(has_message, thought)
    custom_id = F.coalesce(F.nullif(text_at(v, "$.custom_id"), F.lit("")), F.lit("unknown"))
    return df.select("*", custom_id.alias("custom_id"), code.isNotNull().alias("is_error"), code.alias("error_code"), F.when(code.isNull(), text).alias("text"), F.when(code.isNull(), reasoning).alias("reasoning"))


def detect_format(v: Column, endpoint: Column | None = None) -> Column:
    """openrouter or openai, by the request's endpoint or what a result's body holds."""
    choice = BODY + ".choices[0]"
    router = kind_at(v, BODY + ".provider").isNotNull() | kind_at(v, choice + ".native_finish_reason").isNotNull() | truthy(v, choice + ".message.reasoning_details") | truthy(v, choice + ".message.reasoning")
    if endpoint is not None:
        router = F.coalesce(endpoint.startswith("openrouter-"), F.lit(False)) | router
    return F.when(F.coalesce(router, F.lit(False)), "openrouter").otherwise("openai")


def line_text(v: Column) -> Column:
    """The text a result holds for export, null if none: choices first, then output; failures of finishing are not looked at."""
    choice = BODY + ".choices[0]"
    content = F.when(kind_at(v, choice + ".message.content") == "STRING", text_at(v, choice + ".message.content")).when(kind_at(v, choice + ".text") == "STRING", text_at(v, choice + ".text"))
    return F.when(~truthy(v, "$.error") & ~truthy(v, BODY + ".error"), F.coalesce(content, F.nullif(_output_text(v, "message", "output_text"), F.lit(""))))


def extract_text(df: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """The exported text of each file of lines: texts in order, a blank line between; the lines themselves if there is none."""
    found = df.withColumn("t", line_text(F.col("v"))).groupBy(file_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.col(order_col).alias("o"), "t")))).alias("ts"), F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), "line"))).alias("ls"))
    joined = trim_all(F.array_join(F.transform("ts", lambda x: F.concat(x["t"], F.lit("\n\n"))), ""))
    return found.select(file_col, F.when(joined != "", joined).otherwise(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def number_at(v: Column, path: str) -> Column:
    """A number that is written as one; anything else is 0."""
    return F.when(F.coalesce(kind_at(v, path).rlike("BIGINT|DOUBLE|DECIMAL"), F.lit(False)), F.coalesce(text_at(v, path).try_cast("double"), F.lit(0.0))).otherwise(0.0)
