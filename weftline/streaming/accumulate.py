"""What a finished stream amounts to: choices, last values and merged usage of its events, by DataFrame operations alone.

Events are rows (request_id, seq, data), ``data`` one JSON event. A request's events meet in
groups that combine before the shuffle where the rule allows it (last values, merged usage);
only texts are collected, each of one choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import parsed_json
from weftline.operators.jsonl import kind_at, text_at, truthy

_KEY = "request_id"


def parsed(events: DataFrame) -> DataFrame:
    """Events with their variant; what is not JSON is left out."""
    return events.select(_KEY, "seq", parsed_json(F.col("data")).alias("v")).where("v is not null")


def last(path: str, name: str, v: str = "v") -> Column:
    """The last value at a path that is none of null, 0, false and empty."""
    return F.max_by(text_at(F.col(v), path), F.when(truthy(F.col(v), path), F.col("seq"))).alias(name)


def joined(value: Column, name: str) -> Column:
    """Texts in the order of events; null if there is none."""
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("seq").alias("s"), value.alias("t")))))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias(name)


def string_at(v: Column, path: str) -> Column:
    """A string that is written as one, else null."""
    return F.when(kind_at(v, path) == "STRING", text_at(v, path))


def merged(rows: DataFrame, path: str, name: str) -> DataFrame:
    """(request_id, name): the objects at a path, merged shallowly by key, the last one's values first; a map of JSON texts."""
    fields = rows.select(_KEY, "seq", F.try_variant_get("v", path, "map<string,variant>").alias("m")).where("m is not null").select(_KEY, "seq", F.explode("m").alias("k", "x"))
    latest = fields.groupBy(_KEY, "k").agg(F.max_by(F.to_json("x"), "seq").alias("x"))
    return latest.groupBy(_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias(name))


def _choices(rows: DataFrame) -> DataFrame:
    """(request_id, seq, index, c): the choices of all events; an index that is no number is 0."""
    each = rows.select(_KEY, "seq", F.posexplode(F.try_variant_get("v", "$.choices", "array<variant>")).alias("at", "c"))
    index = F.when(F.coalesce(kind_at(F.col("c"), "$.index").rlike("BIGINT|DOUBLE|DECIMAL"), F.lit(False)), text_at(F.col("c"), "$.index").try_cast("int"))
    return each.select(_KEY, F.struct("seq", "at").alias("seq"), F.coalesce(index, F.lit(0)).alias("index"), "c")


def _with_head(rows: DataFrame, choices: DataFrame, fields: dict[str, str]) -> DataFrame:
    head = rows.groupBy(_KEY).agg(*(last(path, name) for name, path in fields.items()))
    head = head.join(merged(rows, "$.usage", "usage"), _KEY, "left")
    listed = choices.groupBy(_KEY).agg(F.array_sort(F.collect_list(F.struct(*[c for c in choices.columns if c != _KEY]))).alias("choices"))
    return head.join(listed, _KEY, "left")


def accumulate_chat(events: DataFrame, router: bool = False) -> DataFrame:
    """(request_id, id, model, usage, choices): one row for each request.

    A choice is (index, role, content, reasoning_content, finish_reason): deltas joined in order, the
    last role and finish_reason. With ``router`` also the last provider and native_finish_reason,
    ``reasoning``, and ``reasoning_details`` merged by type and index, in place of which the flat
    copies go.
    """
    rows = parsed(events)
    each, c = _choices(rows), F.col("c")
    parts = [
        F.coalesce(F.max_by(string_at(c, "$.delta.role"), F.when(string_at(c, "$.delta.role").isNotNull(), F.col("seq"))), F.lit("assistant")).alias("role"),
        F.coalesce(joined(string_at(c, "$.delta.content"), "x"), F.lit("")).alias("content"), joined(string_at(c, "$.delta.reasoning_content"), "reasoning_content"),
        F.max_by(string_at(c, "$.finish_reason"), F.when(string_at(c, "$.finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
    ]
    if router:
        parts += [joined(string_at(c, "$.delta.reasoning"), "reasoning"), F.max_by(string_at(c, "$.native_finish_reason"), F.when(string_at(c, "$.native_finish_reason").isNotNull(), F.col("seq"))).alias("native_finish_reason")]
    choices = each.groupBy(_KEY, "index").agg(*parts)
    if router:
        d = F.col("d")
        details = each.select(_KEY, "index", "seq", F.posexplode(F.try_variant_get(c, "$.delta.reasoning_details", "array<variant>")).alias("n", "d"))
        details = details.select(_KEY, "index", F.struct("seq", "n").alias("seq"), text_at(d, "$.type").alias("type"), text_at(d, "$.index").try_cast("int").alias("part"), *(string_at(d, f"$.{k}").alias(k) for k in ("text", "summary", "data")))
        merged_ = details.groupBy(_KEY, "index", "type", "part").agg(F.min("seq").alias("first"), *(joined(F.col(k), k) for k in ("text", "summary", "data")))
        listed = merged_.groupBy(_KEY, "index").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "type", "part", "text", "summary", "data"))), lambda x: F.struct(x["type"].alias("type"), x["part"].alias("index"), x["text"].alias("text"), x["summary"].alias("summary"), x["data"].alias("data"))).alias("reasoning_details"))
        choices = choices.join(listed, [_KEY, "index"], "left").withColumn("reasoning", F.when(F.col("reasoning_details").isNull(), F.coalesce("reasoning", "reasoning_content"))).drop("reasoning_content")
    return _with_head(rows, choices, {"id": "$.id", "model": "$.model"} | ({"provider": "$.provider"} if router else {}))


def accumulate_completions(events: DataFrame) -> DataFrame:
    """(request_id, id, model, usage, choices): choices are (index, text, finish_reason)."""
    rows = parsed(events)
    c = F.col("c")
    choices = _choices(rows).groupBy(_KEY, "index").agg(F.coalesce(joined(string_at(c, "$.text"), "x"), F.lit("")).alias("text"), F.max_by(string_at(c, "$.finish_reason"), F.when(string_at(c, "$.finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    return _with_head(rows, choices, {"id": "$.id", "model": "$.model"})


def accumulate_responses(events: DataFrame) -> DataFrame:
    """(request_id, id, model, status, usage, text, output): the last output, or one built from the deltas where no event holds one.

    Ids, models and usage count at the event's top and in its ``response``.
    """
    rows, v = parsed(events), F.col("v")
    inner = rows.select(_KEY, "seq", F.try_variant_get(v, "$.response", "variant").alias("v")).where("v is not null")
    # the response of an event comes after what stands at its top
    both = rows.select(_KEY, F.struct(F.col("seq").alias("s"), F.lit(0).alias("k")).alias("seq"), "v").unionByName(inner.select(_KEY, F.struct(F.col("seq").alias("s"), F.lit(1).alias("k")).alias("seq"), "v"))
    output = F.when(kind_at(v, "$.output").startswith("ARRAY"), F.to_json(F.try_variant_get(v, "$.output", "variant")))
    head = both.groupBy(_KEY).agg(last("$.id", "id"), last("$.model", "model"), last("$.status", "_status"), F.max_by(output, F.when(output.isNotNull(), F.col("seq"))).alias("_output"))
    deltas = rows.where(text_at(v, "$.type") == "response.output_text.delta").groupBy(_KEY).agg(joined(string_at(v, "$.delta"), "text"))
    out = head.join(merged(both, "$.usage", "usage"), _KEY, "left").join(deltas, _KEY, "left")
    built = F.to_json(F.array(F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content"))))
    return out.select(_KEY, "id", "model", F.coalesce("_status", F.lit("completed")).alias("status"), "usage", "text", F.when(F.coalesce("_output", F.lit("[]")) == "[]", built).otherwise(F.col("_output")).alias("output"))
