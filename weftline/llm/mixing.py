"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is a number of words. A document of a source starts with target / source_size
copies: a whole part and a fraction. Two documents with fractions are paired and word mass moves
from one to the other, by a random choice that keeps each expectation, until one fraction becomes 0
or 1; so the words taken stay as they were. Large documents are rounded first, against each other
and then against the smaller ones together. Blocks of documents each leave one fraction, and these
residuals meet in further rounds of blocks, a reduction tree of fan-in ``BLOCK``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Stage

#: Documents that one block rounds, about; the fan-in of the tree.
BLOCK = 4096
WEIGHTS, BUDGET, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): weights repeat over sources by code point, null last.

    A source's share is its weight times a level, and stops at ``most`` times its size; what that
    leaves raises the level of the others, until no further source stops. Only sums come to the
    driver; sources are numbered by ranges, so that no task holds them all.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = Stage(sizes.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")), "sources")
    begins = parts.df.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    begins = begins.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_begin"))  # a row for each range
    rank = F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = parts.df.withColumn("_p", F.shiftright("_at", 33)).join(begins, "_p").select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most / weight).alias("_stop"))
    rows, level = Stage(ranked, "weights"), -1.0
    parts.drop()
    while True:
        free = F.col("_stop") >= level
        total, taken, w = rows.df.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("source_size") * most)), F.sum(F.when(free, F.col("_w")))).first()
        new = max(level, (budget * (total or 0) - (taken or 0.0)) / w) if w else float("inf")
        if new <= level:
            break
        level = new
    stopped = F.col("_stop") < level
    return rows.df.select("source", "source_size", F.when(stopped, F.col("source_size") * most).otherwise(F.col("_w") * level).alias("target"))


def _settle(p: float) -> float:
    return 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


def round_block(size: np.ndarray, part: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds fractions, keeping the sum of size * part; the row that keeps a fraction, or -1.

    Rows come in an order by size. The larger half is rounded in pairs: mass can go from j to i up
    to ``a`` words or from i to j up to ``b``, and goes the first way with probability b / (a + b),
    so that no fraction changes on average. What one row of it keeps is paired in the same way with
    the smaller half as a whole, whose fractions move alike; then that half is halved in turn. So
    the fraction that remains is a small document's, unless there are too few to take up a large one.
    """
    rng, p = np.random.default_rng(seed), part.astype(np.float64).copy()

    def fractional(rows: np.ndarray) -> np.ndarray:
        return rows[(p[rows] > 0) & (p[rows] < 1)]

    rows = fractional(np.arange(len(p)))
    while len(rows) > 1:
        low, high = rows[: len(rows) // 2], rows[len(rows) // 2 :]
        held = -1
        for j in high.tolist():
            if held < 0:
                held = j
                continue
            i, si, sj = held, float(size[held]), float(size[j])
            a, b = min((1 - p[i]) * si, p[j] * sj), min(p[i] * si, (1 - p[j]) * sj)
            move = a if rng.random() * (a + b) < b else -b
            p[i], p[j] = _settle(p[i] + move / si), _settle(p[j] - move / sj)
            held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
        while held >= 0 and len(low):
            si, total = float(size[held]), float(size[low].sum())
            a, b = min((1 - p[held]) * si, p[low].min() * total), min(p[held] * si, (1 - p[low].max()) * total)
            move = a if rng.random() * (a + b) < b else -b
            p[held] = _settle(p[held] + move / si)
            p[low] = [_settle(x) for x in (p[low] - move / total).tolist()]
            low = fractional(low)
            held = held if 0 < p[held] < 1 else -1
        rows = low if held < 0 else np.append(fractional(low), held)
        if held >= 0 and len(rows) == 1:
            break
    return p, int(rows[0]) if len(rows) and 0 < p[rows[0]] < 1 else -1


def _rounder(level: int, last: bool):
    """Rounds one block, its documents in an order by size and hash, its random numbers seeded by their hashes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "hash"], kind="stable", ignore_index=True)
        seed = int(np.bitwise_xor.reduce(pdf["hash"].to_numpy().astype(np.uint64))) ^ level
        part, kept = round_block(pdf["size"].to_numpy(), pdf["part"].to_numpy(), seed)
        if last and kept >= 0:  # the root's fraction falls to one side by its probability
            part[kept] = float(np.random.default_rng((seed, 1)).random() < part[kept])
        pdf["part"] = part
        return pdf[["_row", "hash", "_source", "size", "part"]]

    return run


def _own_hashes(rows: DataFrame) -> DataFrame:
    """The rows (_row, _source, size, part, hash), the k-th of those with one hash under the hash of both, so that each draws its own numbers.

    Ranks are counted inside the row's partition and offset by the counts of earlier ones, so that no task meets all repeats.
    """
    rows = rows.withColumn("_p", F.shiftright("_row", 33))
    before = rows.groupBy("hash", "_p").agg(F.count("*").alias("_n")).select("hash", "_p", (F.sum("_n").over(Window.partitionBy("hash").orderBy("_p")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("hash", "_p").orderBy("_row")) + F.col("_before")
    return rows.join(before, ["hash", "_p"]).select("_row", F.xxhash64("hash", rank).alias("hash"), "_source", "size", "part")


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id (and ``carry``), size, source_size, target, copies and taken = copies * size.

    Sizes count words; null or empty texts have none, get no copies and take nothing. A null source
    is a source of its own, last. Repeated rows are documents of their own and are rounded apart.
    All random numbers follow from hashes of ids and texts, so that reruns agree. No rows give none.
    """
    keep = [id_col, *(c for c in carry if c != id_col)]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    held = Stage(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(source_col).alias("_source"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash")), "sizes")
    plan = targets(held.df.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, budget, most)
    plan = plan.withColumnRenamed("source", "_s")
    want = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    # joins with a row for each source take no hint: Spark broadcasts those that are small, and splits hot sources of others
    rows = held.df.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("copies", F.floor(want)).withColumn("part", want - F.floor(want))
    whole = Stage(_own_hashes(rows.where("part > 0 and part < 1").select("_row", "_source", "size", "part", "hash")), "parts")
    parts, done, made, level = whole.df, [], [], 0
    while True:
        blocks = Stage(parts.groupBy(F.col("_source").alias("_s")).agg(F.ceil(F.count("*") / BLOCK).alias("_b")), "blocks")
        last = (blocks.df.agg(F.max("_b")).first()[0] or 1) == 1
        dealt = parts.join(blocks.df, F.col("_source").eqNullSafe(F.col("_s"))).select("_row", "hash", "_source", "size", "part", F.pmod(F.xxhash64("hash", F.lit(level)), F.col("_b")).alias("_block"))
        out = Stage(dealt.groupBy("_source", "_block").applyInPandas(_rounder(level, last), "_row long, hash long, _source string, size long, part double"), f"round{level}")
        made += [out, blocks]
        done.append(out.df.where("part >= 1").select("_row"))
        if last:
            break
        parts, level = out.df.where("part > 0 and part < 1"), level + 1
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    extra = Stage(extra.withColumn("_more", F.lit(1)), "extra")
    for stage in (whole, *made):
        stage.drop()
    out = rows.join(extra.df, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0)))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
