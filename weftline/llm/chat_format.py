"""Chat formatting with a grammar round trip, in DataFrame functions alone.

The template writes each turn as a mark line, the escaped text and an end mark:

    <s>### Role: text </turn>

A conversation is first written as it is and read back by the deterministic parser. Where the turns
read back are not those of the source, some character conflicts with the grammar, and the conversation is
written again with a backslash before every backslash, ``<``, ``#`` and ``:`` of its roles and
texts: no mark can then arise inside a text, and the parser needs no look-ahead. It is parsed and
compared again; that escape is total, so a difference that remained would be an error and ends the
query. Results are derived from what was read back, never from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
#: What a text's characters that could begin a mark are escaped with.
ESCAPE = "\\"
_SPECIAL = r"([\\<#:])"


def escape(text: Column) -> Column:
    """Puts a backslash before every character that a mark or an escape could begin with."""
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def unescape(text: Column) -> Column:
    """Drops each escaping backslash; the pair is read from the left, so that escaped backslashes stay."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    """A turn whose role and text are written as they are given."""
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def render(turns: Column, change=lambda x: x) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(change(t["role"]), change(t["text"]))), "")


def same_turns(back: Column, source: Column) -> Column:
    return F.to_json(back) == F.to_json(F.transform(source, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def parse(rendered: Column) -> Column:
    """Turns (role, text) of a rendered conversation: the grammar ``(OPEN role MIDDLE text CLOSE)*``.

    Inside roles and texts ``<``, ``#`` and ``:`` only stand escaped, so the first unescaped mark
    ends them. Each turn is found once, from the left.
    """
    body = r"((?:[^\\<#:]|\\[\s\S])*+)"
    turn = OPEN + body + MIDDLE + body + CLOSE
    pairs = F.arrays_zip(F.regexp_extract_all(rendered, F.lit(turn), F.lit(1)).alias("role"), F.regexp_extract_all(rendered, F.lit(turn), F.lit(2)).alias("text"))
    return F.transform(pairs, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chats(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation: id, formatted, parsed turns (read back), loss (start, length in code points), identical.

    Rows order by turn, then role and text (ties, repeats kept); null turns come first, null texts
    and roles are empty; a null id is a conversation of its own. ``loss`` holds, for each assistant
    turn, where its escaped text stands in ``formatted``. No rows give none. Other columns of
    ``turns`` are not read. A conversation must fit in one row, as its rendered text is one value.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select(F.col(id_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))
    plain = chats.withColumn("_plain", render(F.col("source")))
    tried = plain.withColumn("_back", parse(F.col("_plain"))).withColumn("_same", same_turns(F.col("_back"), F.col("source")))
    shown = tried.withColumn("formatted", F.when(F.col("_same"), F.col("_plain")).otherwise(render(F.col("source"), escape)))
    back = shown.withColumn("turns", F.when(F.col("_same"), F.col("_back")).otherwise(parse(F.col("formatted"))))
    written = lambda x: F.when(F.col("_same"), x).otherwise(escape(x))
    lengths = F.transform("turns", lambda t: F.struct(F.char_length(render_turn(written(t["role"]), written(t["text"]))).alias("all"), F.char_length(written(t["text"])).alias("text"), (t["role"] == "assistant").alias("on")))
    start = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), lambda acc, x: F.struct(
        (acc["at"] + x["all"]).alias("at"),
        F.when(x["on"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["all"] - len(CLOSE) - x["text"]).alias("start"), x["text"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    ))["spans"]
    same = F.col("_same") | same_turns(F.col("turns"), F.col("source"))
    return back.select("conv_id", "formatted", "turns", start.alias("loss"), F.when(same, True).otherwise(F.raise_error(F.lit("a conversation does not come back")).cast("boolean")).alias("identical"))


def digests(chats: DataFrame) -> DataFrame:
    """What the round trip recovered: counts and digests of turns and of the text under the loss mask."""
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = F.array_join(masked, "")
    everything = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(everything.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), F.col("identical").alias("round_trip"),
    )
