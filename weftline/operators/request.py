"""Requests: messages, the bodies of each endpoint, JSONL lines and their ids."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import endpoint_path, fill_template, parsed_json
from weftline.sources.staging import staged

#: Fixed: Spark's increasing ids hold the partition above so many bits of the row's place in it.
_PLACE_BITS = 33


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def user_content(prompt: Column, chunk: Column) -> Column:
    """The chunk put in at ``{{ .TextToInject }}``, or after the prompt and a blank line; without its outer newlines."""
    body = F.regexp_replace(chunk, r"\A[\r\n]+|[\r\n]+\z", "")
    tail = F.regexp_replace(prompt, r"\s+\z", "")
    joined = F.when((prompt != "") & (body != ""), F.concat(tail, F.lit("\n\n"), body)).otherwise(F.concat(prompt, body))
    return F.when(prompt.rlike(r"\{\{\s*\.\s*TextToInject\s*\}\}"), fill_template(prompt, {"TextToInject": body})).otherwise(joined)


def messages(chunk: Column, prompt: str | None = None, system: str | None = None) -> Column:
    rows = [message("system", F.lit(system))] if system else []
    return F.array(*rows, message("user", user_content(F.lit(prompt or ""), chunk)))


def _fields(params: Mapping[str, object]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in params.items()]


def chat_body(msgs: Column, params: Mapping[str, object] = {}, stream: bool | None = None, prefill: str | None = None, prefix: bool = False) -> Column:
    """messages, parameters and, if said, stream. A prefill is an assistant's message; ``prefix`` marks it as one."""
    if prefill is not None:
        fields = [F.lit("assistant").alias("role"), F.lit(prefill).alias("content")]
        if prefix:
            msgs = F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("boolean").alias("prefix")))
            fields.append(F.lit(True).alias("prefix"))
        msgs = F.concat(msgs, F.array(F.struct(*fields)))
    return F.struct(msgs.alias("messages"), *_fields(params), *([] if stream is None else [F.lit(stream).alias("stream")]))


def completions_body(msgs: Column, params: Mapping[str, object] = {}, stream: bool | None = None) -> Column:
    """All contents in one prompt, nothing between them."""
    prompt = F.array_join(F.transform(msgs, lambda m: F.coalesce(m["content"], F.lit(""))), "")
    return F.struct(prompt.alias("prompt"), *_fields(params), *([] if stream is None else [F.lit(stream).alias("stream")]))


def responses_body(msgs: Column, params: Mapping[str, object] = {}, stream: bool | None = None) -> Column:
    """System messages become instructions; others typed parts, of which empty ones go; nothing is stored."""
    system = F.filter(msgs, lambda m: m["role"] == "system")
    parts = lambda m: F.filter(F.array(F.struct(F.when(m["role"] == "assistant", "output_text").otherwise("input_text").alias("type"), m["content"].alias("text"))), lambda p: p["text"] != "")
    rows = F.transform(F.filter(msgs, lambda m: m["role"] != "system"), lambda m: F.struct(F.lit("message").alias("type"), m["role"].alias("role"), parts(m).alias("content")))
    instructions = F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda m: m["content"]), "\n"))
    return F.struct(rows.alias("input"), instructions.alias("instructions"), F.lit(False).alias("store"), *_fields(params), *([] if stream is None else [F.lit(stream).alias("stream")]))


def request_line(custom_id: Column, url: Column, body: Column, meta: Column | None = None) -> Column:
    """One JSON line; absent values are left out."""
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), url.alias("url"), body.alias("body"), *([] if meta is None else [meta.alias("meta")])))


def result_line(custom_id: Column, body: Column | None, error: Column | None) -> Column:
    """A result or a failure; explicit nulls are written."""
    none = F.lit(None).cast("string")
    response = none if body is None else F.struct(F.lit(200).alias("status_code"), F.lit("batch").alias("request_id"), body.alias("body"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), response.alias("response"), (none if error is None else error).alias("error")), {"ignoreNullFields": "false"})


def next_id(existing: DataFrame, id_col: str = "custom_id") -> int:
    """One more than the largest n of request-n, at least 1; one aggregated row comes to the driver."""
    n = F.regexp_extract(F.col(id_col), r"^request-(\d+)", 1).try_cast("long")
    return (existing.agg(F.max(n)).first()[0] or 0) + 1


def compile_requests(chunks: DataFrame, endpoint: str = "chat", prompt: str | None = None, system: str | None = None, params: Mapping[str, object] = {}, first: int = 1) -> DataFrame:
    """Request lines of numbered chunks (doc_id, chunk_no, chunk), ids counted by document from ``first``."""
    msgs = messages(F.col("chunk"), prompt, system)
    body = {"completions": completions_body, "responses": responses_body}.get(endpoint, chat_body)(msgs, params)
    custom_id = F.concat(F.lit("request-"), F.col("chunk_no") + (first - 1))
    return chunks.select("doc_id", "chunk_no", request_line(custom_id, endpoint_path(F.lit(endpoint)), body).alias("line"))


def global_ids(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Consecutive ids over all rows, nulls last, without a single-task window: ranges are sorted, written, counted and offset.

    Ranges are drawn from a sample, anew in each job, so the sorted rows are written with their places
    and both the counts and the ids come from what was written. One count for each range comes to the driver.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    parts = staged(placed, "ranges").withColumn("_p", F.shiftright("_m", _PLACE_BITS).cast("int"))
    offsets, total = [], first
    for p, n in sorted(tuple(r) for r in parts.groupBy("_p").count().collect()):
        offsets.append((p, total - (p << _PLACE_BITS)))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_p int, _o long")
    return parts.join(F.broadcast(table), "_p").withColumn("n", F.col("_m") + F.col("_o")).withColumn("custom_id", F.concat(F.lit("request-"), "n")).drop("_p", "_o", "_m")


def router_body(msgs: Column, params: Mapping[str, object] = {}, provider: Column | None = None, session: Column | None = None, stream: bool | None = None, responses: bool = False) -> Column:
    """A body for the router: that of chat or responses, with a provider's settings and a session's id."""
    more = {k: v for k, v in (("provider", provider), ("session_id", session)) if v is not None}
    return (responses_body if responses else chat_body)(msgs, {**params, **more}, stream)


def _members(json_text: Column) -> Column:
    return F.try_variant_get(parsed_json(json_text), "$", "map<string,variant>")


def overlay(body: Column, extra: Column) -> Column:
    """A JSON body with the members of another laid over it, not merged deeper; nulls lay nothing over."""
    over = _members(extra)
    kept = F.map_filter(_members(body), lambda k, _: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.to_json(F.map_concat(kept, F.coalesce(over, F.create_map().cast("map<string,variant>"))))


#: Fixed: what a run without settings of the request's own takes from a body, as the preset decides it.
PRESET_DECIDES = ("enable_thinking", "chat_template_kwargs", "reasoning_effort", "reasoning", "include", "grammar", "response_format")


def sent_body(body: Column, meta: Column, temperature: Column, supported: tuple[str, ...], preset: Mapping[str, object]) -> Column:
    """The JSON body that is sent for a line, by whether it has settings of its own (``meta``, JSON or null).

    With them, only the supported ones among them replace members of the body, and the temperature is
    that of the settings or the body, or a retry's where it differs. Without them the preset's
    supported parameters do, and the temperature is the attempt's or none.
    """
    b, own = _members(body), _members(meta)
    double = lambda v: F.try_variant_get(v, "$", "double")
    listed = F.array(*(F.lit(k) for k in supported if k != "temperature"))
    base = F.coalesce(F.try_element_at(own, F.lit("temperature")), F.try_element_at(b, F.lit("temperature")))
    retried = F.when(base.isNotNull() & (temperature != double(base)), temperature.cast("double").cast("variant"))
    heat = F.when(own.isNotNull(), F.coalesce(retried, base)).otherwise(temperature.cast("double").cast("variant"))
    ours = _members(F.lit(json.dumps({k: v for k, v in preset.items() if k in supported and k != "temperature"})))
    over = F.when(own.isNotNull(), F.map_filter(own, lambda k, _: F.array_contains(listed, k))).otherwise(ours)
    gone = F.when(own.isNull(), F.array(*map(F.lit, PRESET_DECIDES))).otherwise(F.array().cast("array<string>"))
    gone = F.concat(gone, F.map_keys(over), F.array(F.lit("temperature")) if "temperature" in supported else F.array().cast("array<string>"))
    out = F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(gone, k)), over)
    if "temperature" in supported:
        out = F.when(heat.isNotNull(), F.map_concat(out, F.create_map(F.lit("temperature"), heat))).otherwise(out)
    return F.to_json(out)
