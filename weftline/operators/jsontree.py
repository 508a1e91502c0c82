"""JSON trees: flattening by a chain of variant explodes, missing paths, merging and splitting."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import parsed_json

#: Levels of a tree that are exploded by the engine itself; what is nested deeper is folded in Arrow batches.
LEVELS = 8


def flatten(docs: DataFrame, id_col: str, json_col: str, levels: int = LEVELS, arrays: bool = True) -> DataFrame:
    """(id, path, value): leaves with their path (array<string>, arrays by index) and JSON text; empty containers vanish.

    Each level is one generator over the rows of the level above, in which leaves pass through: one
    scan, nothing shuffled. Null and malformed texts have no leaves. A number keeps its value, not
    its spelling. Without ``arrays`` an array is a leaf.
    """
    rows = docs.select(F.col(id_col), F.array().cast("array<string>").alias("path"), parsed_json(F.col(json_col)).alias("value")).where("value is not null")
    for _ in range(levels):
        view = f"_weftline_{uuid.uuid4().hex}"
        rows.withColumn("nested", _nested(arrays)).createOrReplaceTempView(view)
        rows = rows.sparkSession.sql(f"""select r.`{id_col}`, case when r.nested then concat(r.path, array(coalesce(e.key, cast(e.pos as string)))) else r.path end as path, case when r.nested then e.value else r.value end as value
          from {view} r, lateral variant_explode_outer(case when r.nested then r.value end) e where not (r.nested and e.pos is null)""")
        rows.sparkSession.catalog.dropTempView(view)
    rows = rows.select(id_col, "path", F.to_json("value").alias("value"), _nested(arrays).alias("_nested"))
    kind = dict(docs.dtypes)[id_col]

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, [*p, *q], v) for i, p, t in zip(pdf[id_col], pdf["path"], pdf["value"], strict=True) for q, v in _leaves(json.loads(t), [], arrays)]
            yield pd.DataFrame(out, columns=[id_col, "path", "value"])

    rest = rows.where("_nested").select(id_col, "path", "value").mapInPandas(deeper, f"`{id_col}` {kind}, path array<string>, value string")
    return rows.where("not _nested").select(id_col, "path", "value").unionByName(rest)


def _nested(arrays: bool):
    kind = F.schema_of_variant("value")
    return F.coalesce(kind.startswith("OBJECT") | (kind.startswith("ARRAY") & F.lit(arrays)), F.lit(False))


def _leaves(v, path, arrays=True):
    rows = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) and arrays else None
    if rows is None:
        yield path, json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    else:
        for k, x in rows:
            yield from _leaves(x, [*path, str(k)], arrays)


def _load(text: str | None):
    """A text's tree, None if it is null or malformed."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def missing_paths(source: DataFrame, target: DataFrame, id_col: str) -> DataFrame:
    """Leaves of the source whose path the target lacks; values are not compared."""
    return source.join(target.select(id_col, "path"), [id_col, "path"], "left_anti")


def sorted_json(text):
    """Compact JSON with the keys of every object in byte order; null for what is none."""
    return F.to_json(parsed_json(text))


def unused_keys(keys: DataFrame, texts: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Dotted keys (key) that stand in none of the texts (text), as a word of letters, digits, _, - and dots; exempt prefixes aside.

    Texts are cut into such words, which meet the keys by equality: no key is searched in every text.
    A word ``a?.b`` counts as ``a.b``, and a word holds each key that its last parts spell.
    """
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", r"\?\.", "."), F.lit(r"[\w-]+(?:\.+[\w-]+)*"), F.lit(0)))).alias("w")).distinct()
    parts = F.split("w", r"\.+")
    tails = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("key")).distinct()
    wanted = keys
    for p in exempt or []:
        wanted = wanted.where(~F.col("key").startswith(p))
    return wanted.join(tails, "key", "left_anti")


def strict_schema(value) -> dict:
    """A JSON schema that all keys are required in: arrays by their first element, every scalar a string."""
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: strict_schema(v) for k, v in value.items()}, "required": list(value), "additionalProperties": False}
    if isinstance(value, list):
        return {"type": "array", "items": strict_schema(value[0]) if value else {"type": "string"}}
    return {"type": "string"}


def prefix_differences(keys: DataFrame, base: str) -> DataFrame:
    """(prefix, missing, extra) of keys (prefix, suffix): how each prefix's suffixes differ from those of ``base``; equal ones are left out."""
    sets = keys.groupBy("prefix").agg(F.array_sort(F.collect_set("suffix")).alias("s"))
    want = sets.where(F.col("prefix") == base).select(F.col("s").alias("w"))
    both = sets.where(F.col("prefix") != base).join(F.broadcast(want), how="left")  # one row
    w = F.coalesce("w", F.array().cast("array<string>"))
    return both.select("prefix", F.array_except(w, "s").alias("missing"), F.array_except("s", w).alias("extra")).where("size(missing) + size(extra) > 0")


def merge_whole(target, source):
    """Objects merge by key, the source first; arrays and scalars are replaced whole."""
    if not isinstance(target, dict) or not isinstance(source, dict):
        return source
    return {**target, **{k: merge_whole(target[k], v) if k in target else v for k, v in source.items()}}


def put_text(body, text: str):
    """A response's body with its text replaced: the first choice's message or text, or the output texts of its messages (the first takes all)."""
    out = json.loads(json.dumps(body))
    if out.get("choices"):
        c = out["choices"][0]
        if isinstance(c.get("message"), dict):
            c["message"]["content"] = text
        else:
            c["text"] = text
        return out
    for item in out.get("output") or []:
        for part in (item.get("content") or []) if item.get("type") == "message" else []:
            if part.get("type") == "output_text":
                part["text"], text = text, ""
    return out


def deep_merge(target, source):
    """The source wins; objects and arrays merge by key, and arrays become objects keyed by index."""
    if not isinstance(source, dict | list):
        return source
    keyed = lambda v: dict(v) if isinstance(v, dict) else {str(k): x for k, x in enumerate(v)} if isinstance(v, list) else {}
    out = keyed(target)
    for k, v in keyed(source).items():
        out[k] = deep_merge(out[k], v) if k in out and isinstance(v, dict | list) else deep_merge({}, v) if isinstance(v, dict | list) else v
    return out


def find_missing(source, target):
    """What of the source's tree the target lacks, None if nothing or if it is a scalar; the topmost missing key carries its whole subtree."""
    if not isinstance(source, dict | list):
        return None
    out = {}
    rows = source.items() if isinstance(source, dict) else ((str(k), v) for k, v in enumerate(source))
    keyed = target if isinstance(target, dict) else {str(k): v for k, v in enumerate(target)} if isinstance(target, list) else {}
    for k, v in rows:
        if k not in keyed:
            out[k] = v
        elif isinstance(v, dict | list) and (sub := find_missing(v, keyed[k])) is not None:
            out[k] = sub
    return out or None


def unflatten(leaves: list[tuple[list[str], object]]) -> dict:
    """Objects only; a later leaf overwrites a scalar in its way."""
    out: dict = {}
    for path, value in leaves:
        at = out
        for k in path[:-1]:
            if not isinstance(at.get(k), dict):
                at[k] = {}
            at = at[k]
        if path:
            at[path[-1]] = value
    return out


def readable(value, width: int = 80, indent: int = 2, depth: int = 0) -> str:
    """Compact JSON if it is at most ``width`` characters, else one member a line, each by the same rule."""
    compact = json.dumps(value, ensure_ascii=False, separators=(", ", ": "))
    if not isinstance(value, dict | list) or not value or len(compact) <= width:
        return compact
    pad, end = " " * indent * (depth + 1), " " * indent * depth
    rows = [f"{json.dumps(k, ensure_ascii=False)}: {readable(v, width, indent, depth + 1)}" for k, v in value.items()] if isinstance(value, dict) else [readable(v, width, indent, depth + 1) for v in value]
    a, b = "{}" if isinstance(value, dict) else "[]"
    return a + "\n" + ",\n".join(pad + r for r in rows) + "\n" + end + b


def split_tree(tree, kilobytes: float = 20) -> list[dict]:
    """Leaves in order, packed greedily into trees whose readable form is at most so many kilobytes (a larger leaf stands alone)."""

    def walk(v, path):
        rows = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else None
        if rows is None:
            yield path, v
        else:
            for k, x in rows:
                yield from walk(x, [*path, str(k)])

    parts, now = [], []
    for leaf in walk(tree, []):
        if now and len(readable(unflatten([*now, leaf])).encode()) > kilobytes * 1024:
            parts.append(unflatten(now))
            now = []
        now.append(leaf)
    return parts + [unflatten(now)] if now else parts


def map_pairs(df: DataFrame, left: str, right: str, carry: list[str], how: str) -> DataFrame:
    """Merges ('merge', or 'whole' arrays) or subtracts ('missing') two JSON columns row by row, in Arrow batches; null and malformed texts count as null."""
    act = {"merge": deep_merge, "missing": find_missing, "whole": merge_whole}[how]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [act(_load(a), _load(b)) for a, b in zip(pdf[left], pdf[right], strict=True)]
            yield pdf[carry].assign(result=[None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found])

    types = dict(df.dtypes)
    return df.select(*carry, left, right).mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in carry) + ", result string")
