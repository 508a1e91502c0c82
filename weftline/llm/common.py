"""What the training-data operators share: tables, written stages, byte-level word tools, components.

Words are ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` splits on exactly those six bytes and
``bytes.lower()`` lower-cases A-Z alone, so every operator works on UTF-8 bytes.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.staging import delete, fresh_path

#: Distinct words that a task counts before it sends them.
HELD_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """A table written to the shared folder: cuts lineage, survives lost executors, can be dropped; what is left is deleted when the driver ends."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, schema = df.sparkSession, df.schema
        self.path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; else they stay until the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def chunks(texts: list[bytes], most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes together (one longer text is a range of its own)."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most_bytes:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, carry: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carry] + list(new.values()), names=carry + list(new))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python by so many rows or bytes at once, whichever is less."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def count_words(texts: DataFrame, lower: bool) -> DataFrame:
    """(word, c) of all words of the only column, A-Z lower-cased if so asked; each task adds up its own before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def send():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()

        for batch in batches:
            for t in text_bytes(batch.column(0)):
                held.update((t.lower() if lower else t).split())
                if len(held) > HELD_WORDS:
                    yield from send()
        yield from send()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int, longest: int) -> dict[bytes, int]:
    """The words (word, c) that stand so often that no more than ``most`` do, with their counts; none longer than ``longest`` bytes.

    The limit is found from numbers of words by bands of counts (16 to a doubling), never by a sort:
    words of one band stay or go together, so that fewer than ``most`` may come back.
    """
    rows = counts.where(F.octet_length("word") <= longest).withColumn("_band", F.floor(16 * F.log2(F.col("c"))))
    left, least = most, None
    for band, n in sorted((tuple(r) for r in rows.groupBy("_band").count().collect()), reverse=True):  # at most 16 * 63 bands
        if n > left:
            break
        left, least = left - n, band
    return {} if least is None else {r[0].encode(): r[1] for r in rows.where(F.col("_band") >= least).select("word", "c").collect()}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), for arrays of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> Stage:
    """(node, component) for the longs in edges(src, dst); component is the least node reachable.

    Alternating large-star and small-star rounds: each moves every neighbour of a node to the least
    one, and the edges end as stars. All rounds are distributed joins on keys whose hot values only
    meet minima that were combined before the shuffle; each is written to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    clean = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null and src <> dst").distinct()
    now, mark = Stage(clean, "edges"), None
    for _ in range(most_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # written, so that a hub's edges, not an aggregate, are dealt to the join and can be split
        large = Stage(both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least.drop()
        least = Stage(large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        pulled = large.df.join(least.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = Stage(pulled.unionByName(least.df.select("u", F.col("m").alias("v"))).distinct(), "small")
        # no value of an edge set is its own mark by chance but with probability 2**-64
        seen = small.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        now.drop(), large.drop(), least.drop()
        now = small
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    out = Stage(now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    now.drop()
    return out
