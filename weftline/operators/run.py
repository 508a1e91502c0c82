"""Running a batch: pacing, waits, temperatures and the ladder of decisions after each attempt.

``run_batches`` calls a pluggable ``model_fn(line, attempt, temperature) -> outcome`` on the
executors, batch by batch from the driver, as aborting and the failure budget follow a global order.
Each batch is written and read back before it is judged, so that a lost executor never calls the
model again for rows that are saved. The windowed forms compute the same rules over a table of attempts.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import MODERATION_WORDS, fill_template, is_moderation_block

#: Fixed: statuses that end a run at once (403 unless moderated).
FATAL = (400, 401, 402, 403, 429, 503)
#: Fixed: longest wait between attempts, and the random part that is added.
MOST_WAIT_MS, JITTER_MS = 60_000.0, 1000.0
RESULT = "n long, custom_id string, decision string, attempts int, failures int, waited_ms double, text string, error_code string, error_message string"


@dataclass(frozen=True)
class Limits:
    """Settings of a run; a request's own ``overrides`` (a map of these names) come first. ``max_fail`` 0: no limit."""

    batch_size: int = 1
    max_attempts: int = 2
    max_fail: int = 5
    retry_delay_ms: float = 5000
    temperatures: tuple[float, ...] = ()
    failure_ends_run: bool = False
    per_minute: float | None = None
    parallel: int = 1


@dataclass
class Outcome:
    status: int = 200
    text: str = ""
    code: str = ""
    message: str = ""
    retry_after: float | None = None
    extra: dict = field(default_factory=dict)

    @property
    def good(self) -> bool:
        return self.status == 200 and not self.code


def decide(o: Outcome, attempt: int, failures: int, limits: Limits) -> str:
    """ok, abort, fail or retry, in the order of the rules; ``failures`` counts this attempt."""
    if o.good:
        return "ok"
    blocked = o.code == "CONTENT_FILTER_TRIGGERED" or o.status == 403 and any(w in o.message.lower() for w in MODERATION_WORDS)
    if 0 < limits.max_fail <= failures or o.status in FATAL and not blocked:
        return "abort"
    if blocked:
        return "fail"
    if limits.failure_ends_run:
        return "abort"
    return "fail" if attempt >= limits.max_attempts else "retry"


def wait_ms(attempt: int, delay_ms: float, jitter: float, retry_after: float | None = None) -> float:
    """Before the next attempt: what the server asks, or twice as long each time up to a minute."""
    return retry_after * 1000 + jitter if retry_after is not None else min(MOST_WAIT_MS, 2.0 ** (attempt - 1) * delay_ms + jitter)


def backoff(attempt: Column, delay_ms: Column, jitter: Column, retry_after: Column) -> Column:
    return F.when(retry_after.isNotNull(), retry_after * 1000 + jitter).otherwise(F.least(F.lit(MOST_WAIT_MS), F.pow(F.lit(2.0), attempt - 1) * delay_ms + jitter))


def temperature(values: Column, attempt: Column, base: Column) -> Column:
    """The schedule's value for the attempt, its last for later ones; the base if there is no schedule, none without a base."""
    return F.when(base.isNotNull(), F.when(F.size(values) > 0, F.element_at(values, F.least(attempt, F.size(values)))).otherwise(base))


def paced(rows: DataFrame, arrival: str, order: str, per_minute: float | Column, part: str) -> DataFrame:
    """start_ms: not before arrival, nor sooner than 60000 / per_minute after the one before; in closed form by a running maximum.

    ``per_minute`` may be a column: then a row comes its own gap after the one before it.
    """
    w = Window.partitionBy(part).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.lit(60000.0) / (F.lit(per_minute) if not isinstance(per_minute, Column) else per_minute)
    rows = rows.withColumn("_d", F.sum(gap).over(so_far))
    return rows.withColumn("start_ms", F.max(F.col(arrival) - F.col("_d")).over(so_far) + F.col("_d")).drop("_d")


def ladder(attempts: DataFrame, limits: Limits, part: str, order: str) -> DataFrame:
    """decision of each attempt (status, code, message, attempt) of a run, by the rules of decide(); after an abort all is cancelled."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bad = (F.col("status") != 200) | (F.col("code") != "")
    blocked = is_moderation_block(F.col("status"), F.col("code"), F.col("message"))
    rows = attempts.withColumn("_fails", F.sum(bad.cast("int")).over(w))
    full = F.lit(limits.max_fail > 0) & (F.col("_fails") >= limits.max_fail)
    abort = bad & (full | (F.col("status").isin(*FATAL) & ~blocked) | (F.lit(limits.failure_ends_run) & ~blocked))
    rows = rows.withColumn("_aborts", F.sum(abort.cast("int")).over(w))
    done = F.when(~bad, "ok").when(blocked, "fail").when(F.col("attempt") >= limits.max_attempts, "fail").otherwise("retry")
    own = F.when(abort, "abort").otherwise(done)
    return rows.withColumn("decision", F.when(F.col("_aborts") - abort.cast("int") > 0, "cancelled").otherwise(own)).withColumnRenamed("_fails", "failures").drop("_aborts")


class Task:
    """What one task of a batch knows: failures so far, whether the run has ended, and when the last request went out."""

    def __init__(self, model_fn: Callable[[str, int, float | None], Outcome], limits: Limits, failures: int, sleep: Callable[[float], None], clock: Callable[[], float] = time.monotonic, jitter: Callable[[], float] | None = None):
        self.model_fn, self.limits, self.failures, self.sleep, self.clock = model_fn, limits, failures, sleep, clock
        self.jitter = jitter or (lambda: random.random() * JITTER_MS)
        self.ended, self.last = False, None

    def _pace(self, limits: Limits) -> float:
        """Waits until this task's share of requests a minute allows the next one; how long, in ms."""
        wait = 0.0
        if limits.per_minute:
            now = self.clock()
            if self.last is not None:
                wait = max(0.0, self.last + 60.0 / limits.per_minute * max(1, limits.parallel) - now)
                if wait:
                    self.sleep(wait)
            self.last = now + wait
        return 1000 * wait

    def request(self, line: str, overrides: dict | None = None) -> tuple:
        """(decision, attempts, failures, waited_ms, text, error_code, error_message) of one request."""
        if self.ended:
            return "cancelled", 0, 0, 0.0, None, "ABORTED", "the run had ended"
        known = {k: v for k, v in (overrides or {}).items() if v is not None and k in Limits.__dataclass_fields__}
        limits = replace(self.limits, **known) if known else self.limits
        attempt, fails, waited = 1, 0, 0.0
        while True:
            waited += self._pace(limits)
            t = limits.temperatures[min(attempt, len(limits.temperatures)) - 1] if limits.temperatures else None
            o = self.model_fn(line, attempt, t)
            fails += not o.good
            self.failures += not o.good
            what = decide(o, attempt, self.failures, limits)
            if what != "retry":
                break
            wait = wait_ms(attempt, limits.retry_delay_ms, self.jitter(), o.retry_after)
            self.sleep(wait / 1000)
            waited += wait
            attempt += 1
        self.ended = what == "abort"
        code = None if what == "ok" else "MAX_FAIL_REACHED" if what == "abort" and 0 < limits.max_fail <= self.failures else o.code or "max_retries"
        return what, attempt, fails, waited, o.text if what == "ok" else None, code, None if what == "ok" else o.message


def run_batches(requests: DataFrame, model_fn: Callable[[str, int, float | None], Outcome], limits: Limits, path: str, batches: int, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] | None = None) -> str:
    """Runs numbered requests (n, custom_id, line, and overrides if there) batch by batch into ``path``; 'done' or 'aborted'.

    A batch runs in ``limits.parallel`` tasks. Each counts failures from those of earlier batches on and
    cancels what it has left after an abort; with one task, the default, that is the exact order of the
    rules, and with more their counts meet when the batch ends. The whole batch is saved (RESULT, with a
    ``batch`` column) before a run ends; a batch that is saved already is counted and not run again.
    """
    spark, failures = requests.sparkSession, 0
    own = "overrides" in requests.columns
    rows = requests.select("n", "custom_id", "line", *(["overrides"] if own else []))
    for k in range(batches):
        place = f"{path}/batch={k}"
        if not _saved(spark, place):
            batch = rows.where((F.col("n") > k * limits.batch_size) & (F.col("n") <= (k + 1) * limits.batch_size))
            dealt = batch.repartitionByRange(limits.parallel, "n").sortWithinPartitions("n") if limits.parallel > 1 else batch.coalesce(1).sortWithinPartitions("n")

            def run(frames: Iterator[pd.DataFrame], before: int = failures) -> Iterator[pd.DataFrame]:
                task = Task(model_fn, limits, before, sleep, jitter=jitter)
                for pdf in frames:
                    found = [(n, i, *task.request(line, dict(o) if o is not None else None)) for n, i, line, o in zip(pdf["n"], pdf["custom_id"], pdf["line"], pdf["overrides"] if own else [None] * len(pdf), strict=True)]
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in RESULT.split(", ")])

            dealt.mapInPandas(run, RESULT).write.mode("overwrite").parquet(place)
        fails, aborted = spark.read.schema(RESULT).parquet(place).agg(F.coalesce(F.sum("failures"), F.lit(0)), F.count_if(F.col("decision") == "abort")).first()
        failures += fails
        if aborted or 0 < limits.max_fail <= failures:
            return "aborted"
    return "done"


def results_of(spark, path: str) -> DataFrame:
    """All saved batches of a run."""
    return spark.read.schema(RESULT + ", batch int").parquet(path)


def _saved(spark, place: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(place + "/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def batch_number(n: Column, size: int) -> Column:
    """Which batch the n-th request is in, from 0."""
    return F.floor((n - 1) / size)


def lowest_limit(rows: DataFrame, part: str, order: str, limit: str, default: int = 5) -> DataFrame:
    """``lowest``: the least positive limit among a row and those after it in its run, or the default."""
    rest = Window.partitionBy(part).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("lowest", F.coalesce(F.min(F.when(F.col(limit) > 0, F.col(limit))).over(rest), F.lit(default)))


def response_lines(results: DataFrame, body: Column) -> DataFrame:
    """(n, line): a result line for each saved request, with ``body`` where it went well and its error where not."""
    from weftline.operators.request import result_line

    good = F.col("decision") == "ok"
    error = F.struct(F.col("error_code").alias("code"), F.coalesce("error_message", F.lit("")).alias("message"))
    return results.select("n", F.when(good, result_line(F.col("custom_id"), body, None)).otherwise(result_line(F.col("custom_id"), None, error)).alias("line"))


def progress(n: Column, total: Column, custom_id: Column, failed: Column, template: str) -> Column:
    """What is said after each request: ``template`` with {{ .Processed }} and {{ .Total }}, and how it ended."""
    said = fill_template(F.lit(template), {"Processed": n.cast("string"), "Total": total.cast("string")})
    return F.concat(said, F.when(failed, F.lit(" [FAILED: ")).otherwise(F.lit(" [OK: ")), custom_id, F.lit("]"))
