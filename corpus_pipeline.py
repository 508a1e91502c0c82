"""A corpus pipeline of five training-data operators, each over all that its predecessor kept.

Quality rules drop the documents they reject, the Jaccard join keeps the least document of each
group, personal data is replaced, sources are mixed to their weights (a document stands as often as
it is taken), and what remains is encoded and decoded. Between stages tables are written as Parquet
and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import encode_decode
from weftline.llm.common import Stage, table
from weftline.llm.jaccard_join import id_filter, jaccard_components
from weftline.llm.mixing import mix_sources
from weftline.llm.pii import find_pii
from weftline.llm.quality_rules import quality_rules
from weftline.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select(*COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id (null last), whatever ids repeat; rows are numbered for it."""
    rows = Stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered").df
    groups = jaccard_components(rows.select("_row", "text"), id_col="_row").select(F.col("id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = Stage(groups, "groups")
    first = groups.df.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    gone = Stage(groups.df.select("_row").join(first, "_row", "left_anti"), "gone")
    groups.drop()
    # a bitmap of the rows that go lets most others pass where they are; only what it cannot tell apart meets them by a shuffle
    maybe, _ = id_filter(gone.df, gone.df.count())
    unsure = rows.where(maybe("_row")).join(gone.df, "_row", "left_anti")
    return rows.where(~maybe("_row")).unionByName(unsure).select(*COLUMNS)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return find_pii(docs, carry=COLUMNS, redact=True).select(*COLUMNS).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix_sources(docs, carry=("text", "lang", "source", "n_chars")).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids, and of the texts decoded from them."""
    return encode_decode(docs, tokenizer_path())


STAGES = [("quality_rules", keep_good), ("jaccard_join", keep_first), ("pii", hide_pii), ("mixing", mix), ("bpe", encode)]
#: Trained rules and random rounding are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stage(stage(spark, docs, sf_dir), name).df
    return docs
