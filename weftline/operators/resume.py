"""Which requests are pending, what a retry replaces, and line-by-line comparison: semi, anti and outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import natural_key, strip_empty


def _ids(rows: DataFrame) -> DataFrame:
    return rows.where("custom_id is not null and custom_id not in ('', 'unknown')").select("custom_id").distinct()


def pending(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests without any result, failed or not; duplicates stay."""
    return requests.join(_ids(results), "custom_id", "left_anti")


def pending_retry(requests: DataFrame, results: DataFrame, retried: DataFrame) -> DataFrame:
    """Requests that failed before and are not in the new target yet."""
    return requests.join(_ids(results.where("is_error")), "custom_id", "left_semi").join(_ids(retried), "custom_id", "left_anti")


def merge_retries(original: DataFrame, retries: DataFrame) -> DataFrame:
    """(line, part, ord): each original line, or the last good retry of its id; then good retries of other ids as first seen.

    Both sides hold custom_id, line_no, line and is_error; a retry that failed last is none.
    """
    last = retries.where("custom_id is not null").groupBy("custom_id").agg(F.max_by("line", "line_no").alias("new"), F.max_by("is_error", "line_no").alias("bad"), F.min("line_no").alias("first"))
    good = last.where("not bad")
    kept = original.join(good, "custom_id", "left").select(F.coalesce("new", "line").alias("line"), F.lit(0).alias("part"), F.col("line_no").alias("ord"))
    rest = good.join(original.select("custom_id"), "custom_id", "left_anti").select(F.col("new").alias("line"), F.lit(1).alias("part"), F.col("first").alias("ord"))
    return kept.unionByName(rest)


def compare_lines(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of lines in the same place of two texts (key, pos, line); a missing one is empty."""
    a, b = left.withColumnRenamed("line", "left_line"), right.withColumnRenamed("line", "right_line")
    return a.join(b, [key, "pos"], "full_outer").select(key, "pos", F.coalesce("left_line", F.lit("")).alias("left_line"), F.coalesce("right_line", F.lit("")).alias("right_line"))


def page_of(offset_col: str, breaks_col: str):
    """The page whose range holds the offset; the last page if none does."""
    at = F.expr(f"size(filter({breaks_col}, x -> x <= {offset_col}))")
    return F.least(at, F.size(breaks_col) - 1)


def with_defaults(meta_url: Column, meta_endpoint: Column, has_meta: Column, url: str, endpoint: str) -> tuple[Column, Column]:
    """Where a request goes: its own settings if it has any, else those of the run."""
    return F.when(has_meta, meta_url).otherwise(F.lit(url)), F.when(has_meta, meta_endpoint).otherwise(F.lit(endpoint))


def compare_texts(pairs: DataFrame, key: str, left: str, right: str, force: bool = False) -> DataFrame:
    """(key, pos, left_line, right_line, error) of two texts without empty lines, place by place, in one row's arrays.

    Where they have different numbers of lines there is one row with LINE_COUNT, unless forced: then
    a missing line is empty.
    """
    a, b = F.split(strip_empty(F.col(left)), "\n", -1), F.split(strip_empty(F.col(right)), "\n", -1)
    both = pairs.select(key, a.alias("a"), b.alias("b"))
    zipped = F.transform(F.arrays_zip("a", "b"), lambda z: F.struct(F.coalesce(z["a"], F.lit("")).alias("l"), F.coalesce(z["b"], F.lit("")).alias("r"), F.lit(None).cast("string").alias("e")))
    wrong = F.array(F.struct(F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("r"), F.lit("LINE_COUNT").alias("e")))
    rows = zipped if force else F.when(F.size("a") == F.size("b"), zipped).otherwise(wrong)
    return both.select(key, F.posexplode(rows).alias("pos", "x")).select(key, "pos", F.col("x.l").alias("left_line"), F.col("x.r").alias("right_line"), F.col("x.e").alias("error"))


def keep_latest(rows: DataFrame, key: str, order: tuple[str, ...], most: int) -> DataFrame:
    """The newest rows of each key, at most so many; Spark drops the others of each task before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")


def merge_files(files: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """(folder, place, content): each file under its header, ``place`` its natural order in the folder.

    One row for each file, so that a folder of any size is written in order by a sort, never held by
    a task; contents follow each other as they are, without a newline between.
    """
    return files.select(F.col(folder).alias("folder"), natural_key(F.col(name)).alias("place"), F.concat(F.lit("--- File: "), name, F.lit(" ---\n"), text).alias("content"))
