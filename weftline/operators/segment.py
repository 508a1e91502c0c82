"""Cutting texts into chunks, narrow and without a shuffle: only splits, slices and explodes of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, java_pattern


def fixed_chunks(text: Column, lines: int) -> Column:
    """Chunks of so many lines; an empty text is one empty chunk."""
    if lines < 1:
        raise ValueError("INVALID_CHUNK_SIZE")
    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / lines).cast("int") - 1), lambda i: F.array_join(F.slice(rows, i * lines + 1, lines), "\n"))
    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), cut))  # bound by a transform, so that a text is split once and not for each chunk


def pattern_chunks(text: Column, pattern: str) -> Column:
    """Cuts where a match of the pattern begins; what precedes the first is a chunk, and none is empty.

    Matches are marked with U+0001, which normalising removes from texts, and the text is cut there.
    """
    marked = F.regexp_replace(text, "(?dm)" + java_pattern(pattern), "\u0001$0")
    return F.filter(F.split(marked, "\u0001", -1), lambda x: x != "")


def explode_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, chunk): pos counts from 0 before any filter."""
    return docs.select(id_col, F.posexplode(chunks).alias("pos", "chunk"))


def numbered_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_no, chunk): chunks that are not blank, numbered from 1 in each document. Blank ones go before the explode, so nothing is shuffled."""
    kept = F.filter(chunks, lambda x: ~is_blank(x))
    return docs.select(id_col, F.posexplode(kept).alias("_pos", "chunk")).select(id_col, (F.col("_pos") + 1).alias("chunk_no"), "chunk")


def named_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """Names chunks by their place before blank ones go, so that gaps remain."""
    return explode_chunks(docs, chunks, id_col).where(~is_blank(F.col("chunk"))).select(id_col, F.concat(F.lit("chunk-"), F.col("pos") + 1).alias("chunk_name"), "chunk")


def first_chunk(chunks: Column) -> Column:
    return F.coalesce(F.try_element_at(chunks, F.lit(1)), F.lit(""))


def size_parts(text: Column, most_bytes: float) -> Column:
    """Packs whole lines (with their newline) into parts of at most so many bytes; a longer line is a part of its own.

    One fold over the lines keeps where each part ends (in characters), and the text is cut there.
    """
    lines = F.regexp_extract_all(text, F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(line).cast("long")
        over = (acc["n"] > 0) & (acc["n"] + size > most_bytes)
        return F.struct(F.when(over, size).otherwise(acc["n"] + size).alias("n"), (acc["at"] + F.char_length(line)).alias("at"), F.when(over, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    cut = lambda s: F.zip_with(F.concat(F.array(F.lit(0)), s["cuts"]), F.concat(s["cuts"], F.array(s["at"])), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    where = F.aggregate(lines, start, step, cut)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(where, lambda w: F.substring(text, w["from"] + 1, w["to"] - w["from"])))


def slices(text: Column, size: int) -> Column:
    """Pieces of so many characters, the last one shorter; none of an empty text."""
    if size < 1:
        raise ValueError("INVALID_CHUNK_SIZE")
    count = F.ceil(F.char_length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_size(given: Column, preset: Column, default_preset: Column, fallback: int) -> Column:
    """The first that is set: what was given, the preset's, the default preset's, the general one."""
    return F.coalesce(given, preset, default_preset, F.lit(fallback))
