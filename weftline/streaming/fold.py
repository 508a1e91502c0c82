"""Server-sent events: parsing, folding deltas, the delta-or-final rule, gaps; batch forms and a stateful stream on one function."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_events(text: str) -> tuple[list[str], str, bool]:
    """(data of complete events, remainder, done): events end at a blank line, comments go, data lines join, [DONE] ends."""
    *whole, rest = text.replace("\r\n", "\n").split("\n\n")
    out = []
    for event in whole:
        data = "\n".join(line[5:].removeprefix(" ") for line in event.split("\n") if line.startswith("data:"))
        if data.strip() == "[DONE]":
            return out, "", True
        if data:
            out.append(data)
    return out, rest, False


def items(data: str) -> list[tuple[str, str]]:
    """(text, kind) of one event of any endpoint; bad JSON is an error item."""
    try:
        e = json.loads(data)
    except ValueError:
        return [(data, "error")]
    if not isinstance(e, dict):
        return [(data, "error")]
    if e.get("error") or e.get("type") in ("error", "response.failed"):
        return [(json.dumps(e.get("error") or e), "error")]
    if e.get("type") == "response.output_text.delta":
        return [(e.get("delta") or "", "delta")]
    if str(e.get("type", "")).startswith("response.reasoning") and str(e["type"]).endswith(".delta"):
        return [(e.get("delta") or "", "reasoning")]
    if e.get("type") == "response.output_text.done":
        return [(e.get("text") or "", "output")]
    out = []
    for c in e.get("choices") or []:
        d = c.get("delta") or {}
        thought = d.get("reasoning_content") or d.get("reasoning")
        out += [(thought, "reasoning")] if thought else []
        out += [(d["content"], "delta")] if d.get("content") else []
        out += [(c["text"], "delta")] if c.get("text") else []
        message = c.get("message") or {}
        out += [(message["content"], "conditional")] if message.get("content") else []
    return out


def fold(events: list[str]) -> dict:
    """text, reasoning, error of a request's events in order: final forms only count while no delta came before."""
    text, reasoning, error, seen = "", "", None, False
    for data in events:
        for t, kind in items(data):
            if kind == "error":
                error = error or t
            elif kind == "reasoning":
                reasoning += t
            elif kind == "delta":
                text, seen = text + t, True
            elif not seen:
                text += t
    return {"text": text, "reasoning": reasoning, "error": error}


def fold_streams(raw: DataFrame) -> DataFrame:
    """(request_id, body) whole streams to (request_id, text, reasoning, error, ended), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, body in zip(pdf["request_id"], pdf["body"], strict=True):
                events, rest, done = parse_events(body or "")
                if not done and rest.startswith("data:"):
                    events += [rest[5:].strip()]  # a last event without its blank line
                f = fold(events)
                rows.append((i, f["text"], f["reasoning"], f["error"], done))
            yield pd.DataFrame(rows, columns=["request_id", "text", "reasoning", "error", "ended"])

    return raw.select("request_id", "body").mapInPandas(run, f"request_id {dict(raw.dtypes)['request_id']}, text string, reasoning string, error string, ended boolean")


def fold_items(rows: DataFrame, key: str, seq: str, kind: str, text: str) -> DataFrame:
    """The same rule natively, over rows of items: deltas always count, final forms only before any delta."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col(kind) == "delta").cast("int")).over(w), F.lit(0))
    kept = rows.withColumn("_keep", (F.col(kind) == "delta") | (F.col(kind).isin("output", "conditional") & (seen == 0)))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))), lambda x: x["t"]), "").alias("text"), F.count_if("_keep").alias("kept"), F.count("*").alias("events"))


def idle_gaps(events: DataFrame, key: str, order: tuple[str, ...], seconds: float) -> DataFrame:
    """Gaps longer than so many seconds between events of a key, in an order whose first column is the time."""
    ts = order[0]
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("gap_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(before.cast("timestamp")) / 1e6).where(F.col("gap_s") > seconds)


def fold_live(events: DataFrame, idle_minutes: float | None = 5) -> DataFrame:
    """A streaming DataFrame (request_id, seq, ts, data) to one row per ended request.

    State holds a request's items in order of arrival; [DONE], an error or an idle timeout
    (none if None; with one, batches go on while a state waits) ends it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame([(*key, fold(held)["text"], "TIMEOUT_ERROR")], columns=["request_id", "text", "error"])
            return
        held, ended = json.loads(state.get[0]) if state.exists else [], False
        for pdf in frames:
            for data in pdf.sort_values("seq")["data"]:
                ended = ended or data.strip() == "[DONE]"
                if not ended:
                    held.append(data)
        f = fold(held)
        if ended or f["error"]:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, f["text"], f["error"])], columns=["request_id", "text", "error"])
        else:
            state.update((json.dumps(held),))
            if idle_minutes is not None:
                state.setTimeoutDuration(int(idle_minutes * 60_000))

    return events.groupBy("request_id").applyInPandasWithState(run, "request_id string, text string, error string", "held string", "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)
