"""Statistics of texts and of result batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import graphemes, is_blank, normalize
from weftline.operators.jsonl import BODY, number_at, result_code, text_at
from weftline.sources.staging import staged

#: Costs are summed as integers of a billionth.
NANO = 1_000_000_000
USAGE = {
    "cost_nano": ("cost", NANO), "prompt_tokens": ("prompt_tokens", 1), "completion_tokens": ("completion_tokens", 1), "total_tokens": ("total_tokens", 1),
    "cached_tokens": ("prompt_tokens_details.cached_tokens", 1), "cache_write_tokens": ("prompt_tokens_details.cache_write_tokens", 1), "audio_prompt_tokens": ("prompt_tokens_details.audio_tokens", 1), "video_prompt_tokens": ("prompt_tokens_details.video_tokens", 1),
    "reasoning_tokens": ("completion_tokens_details.reasoning_tokens", 1), "image_tokens": ("completion_tokens_details.image_tokens", 1), "audio_tokens": ("completion_tokens_details.audio_tokens", 1),
    "upstream_nano": ("cost_details.upstream_inference_cost", NANO), "upstream_prompt_nano": ("cost_details.upstream_inference_prompt_cost", NANO), "upstream_completion_nano": ("cost_details.upstream_inference_completions_cost", NANO),
}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def line_averages(text: Column) -> Column:
    """struct(graphemes, bytes): means over a text's lines that are not blank, rounded half up; 0 without any. One fold, no explode."""
    start = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("n", "graphemes", "bytes")))

    def step(a: Column, x: Column) -> Column:
        return F.when(is_blank(x), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["graphemes"] + graphemes(x)).alias("graphemes"), (a["bytes"] + F.octet_length(x)).alias("bytes")))

    mean = lambda s, k: F.when(s["n"] > 0, half_up(s[k] / s["n"])).otherwise(F.lit(0)).cast("long").alias(k)
    return F.aggregate(F.split(normalize(text), "\n", -1), start, step, lambda s: F.struct(mean(s, "graphemes"), mean(s, "bytes")))


def token_stats(counts: DataFrame) -> DataFrame:
    """Total, mean and exact median of tokens; one row."""
    return counts.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.avg("tokens").alias("mean"), F.median("tokens").alias("median"))


def token_outliers(counts: DataFrame) -> DataFrame:
    """Rows of at least twice or three times the median; the one-row median is broadcast.

    The counts are written once and read for both, so that no text is counted twice.
    """
    counts = staged(counts, "tokens")
    m = counts.agg(F.median("tokens").alias("median"))
    rows = counts.crossJoin(F.broadcast(m))
    return rows.withColumn("outlier", F.when(F.col("tokens") >= 3 * F.col("median"), "triple").when(F.col("tokens") >= 2 * F.col("median"), "double")).where("outlier is not null").drop("median")


def batch_rows(lines: DataFrame) -> DataFrame:
    """Result lines with failure code (a missing status fails), model, provider and usage."""
    v = F.col("v")
    usage = [half_up(number_at(v, f"{BODY}.usage.{path}") * k).cast("long").alias(name) if k > 1 else number_at(v, f"{BODY}.usage.{path}").cast("long").alias(name) for name, (path, k) in USAGE.items()]
    return lines.select("*", F.coalesce(result_code(v, True), F.lit("ok")).alias("outcome"), F.nullif(text_at(v, BODY + ".model"), F.lit("")).alias("model"), F.nullif(text_at(v, BODY + ".provider"), F.lit("")).alias("provider"), *usage)


def batch_stats(rows: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "ok"
    sums = [F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("long").alias(name) for name in USAGE]
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), *sums)


def counts_by(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Good rows by a column's values, with where each was seen first."""
    return rows.where((F.col("outcome") == "ok") & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def failures(rows: DataFrame, order: str) -> DataFrame:
    """(custom_id or line-n, status, outcome) of failed rows."""
    v = F.col("v")
    name = F.coalesce(F.nullif(text_at(v, "$.custom_id"), F.lit("")), F.concat(F.lit("line-"), F.col(order)))
    return rows.where("outcome <> 'ok'").select(F.col(order), name.alias("custom_id"), F.coalesce(text_at(v, "$.error.code"), text_at(v, "$.response.status_code"), F.lit("n/a")).alias("status"), "outcome")


def shown_sums(stats: DataFrame) -> DataFrame:
    """(name, shown) of one row of batch sums: costs with six digits, numbers of tokens; zeros are hidden, and a cost that repeats the upstream's."""
    total, upstream = F.col("cost_nano"), F.col("upstream_nano")
    names = [k for k in USAGE if k in stats.columns]
    shown = {k: F.format_string("%.6f", F.col(k) / NANO) if USAGE[k][1] > 1 else F.col(k).cast("string") for k in names}
    on = {k: (F.col(k) > 0) & (total != upstream if k == "cost_nano" else F.lit(True)) for k in names}
    return stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.when(on[k], shown[k]).alias("shown")) for k in names])).alias("x")).select("x.name", "x.shown").where("shown is not null")
