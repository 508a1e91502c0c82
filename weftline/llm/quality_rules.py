"""Quality rules: an isolation forest over rule statistics, with a cut calibrated on labelled rows.

Statistics of a text (null: empty) are exact and cover all of it. The forest is fitted on a bounded
sample of labelled rows (``SAMPLE``), least by a hash of the id, in which bad rows are thinned out
until they are rare; its cut is where labelled good rows are all but kept. Every row is then scored by the same trees. Ties on the hash and repeated
rows give the same statistics; without labels the forest is not fitted and only the base rules act.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, small_batches, text_bytes, with_columns

#: Labelled rows that the forest and its cut are fitted on, at most.
SAMPLE = 6000
TREES, LEAF_SAMPLE = 100, 256
#: Rows labelled bad that the trees see, to rows labelled good.
RARE = 0.02
#: The base rules: fewer words than this, or a larger percentage of repeated words, fail a document.
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
EXTRA = ("n_lines", "n_upper", "n_marks", "n_end_marks", "n_same_next", "n_distinct")

_CLASS = np.zeros((256, 5), dtype=np.uint8)  # blank, continuation byte, symbol, upper case, mark
_CLASS[[9, 10, 11, 12, 13, 32], 0] = 1
_CLASS[128:192, 1] = 1
_CLASS[[ord(c) for c in "#*$%&|<>"], 2] = 1
_CLASS[65:91, 3] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()], 4] = 1


def _repeated(ids: np.ndarray) -> int:
    """Words that some three-word window covers which occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    threes = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, back, count = np.unique(threes, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base statistics and EXTRA of each text."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in (*BASE, *EXTRA)}
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            continue
        kinds = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) @ _CLASS
        seen: dict[bytes, int] = {}
        put = seen.setdefault
        ids = np.fromiter((put(w, len(seen)) for w in words), dtype=np.int64, count=n)
        lines = [x for x in t.split(b"\n") if x.strip()]
        row = (n, len(t) - kinds[1] - kinds[0], kinds[2], len(lines) - len(set(lines)), _repeated(ids), len(lines), kinds[3], kinds[4], sum(t.count(x) for x in (b"!!", b"??")), int((ids[1:] == ids[:-1]).sum()), len(seen))
        for k, v in zip(out, row, strict=True):
            out[k][i] = v
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the trees split on: mean word length, and roots of shares, that do not grow with a text's length."""
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    shares = np.stack([s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_marks"] / words, s["n_end_marks"] / words], axis=1)
    return np.concatenate([np.minimum(s["word_chars"] / words, 16)[:, None] / 16, np.sqrt(np.minimum(shares, 1.0))], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Isolation trees in arrays: per node a feature, a threshold and two children, per leaf its path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, each: int = LEAF_SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.feature, self.cut, self.child, self.path = [], [], [], []
        self.roots, self.deep = [], max(1, math.ceil(math.log2(max(2, min(each, len(rows))))))
        self.usual = max(_usual_path(min(each, len(rows))), 1e-9)
        for _ in range(trees if len(rows) else 0):
            self.roots.append(self._grow(rows[rng.permutation(len(rows))[:each]], 0, rng))
        self.feature, self.cut, self.child, self.path = np.array(self.feature, dtype=np.int64), np.array(self.cut), np.array(self.child).reshape(-1, 2), np.array(self.path)

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        at = len(self.feature)
        self.feature.append(0), self.cut.append(np.inf), self.child.append((at, at)), self.path.append(depth + _usual_path(len(rows)))
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < self.deep else []
        if len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            low = rows[:, f] < cut
            left, right = self._grow(rows[low], depth + 1, rng), self._grow(rows[~low], depth + 1, rng)
            self.feature[at], self.cut[at], self.child[at] = f, cut, (left, right)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.deep):
                at = self.child[at, (rows[every, self.feature[at]] >= self.cut[at]).astype(np.int64)]
            total += self.path[at]
        return 2.0 ** -(total / max(1, len(self.roots)) / self.usual)


def calibrate(scores: np.ndarray, good: np.ndarray, cost: float = 10.0) -> float:
    """The cut with the least cost, a lost good row costing ``cost`` times a kept bad one; no cut (2.0) if that is cheapest."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order].astype(float)
    bill = cost * np.cumsum(g) + (1 - g).sum() - np.cumsum(1 - g)
    ends = np.flatnonzero(np.r_[s[1:] < s[:-1], True]) if len(s) else np.zeros(0, dtype=int)
    if not len(ends) or bill[ends].min() >= (1 - g).sum():
        return 2.0
    k = ends[int(np.argmin(bill[ends]))]
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def mostly_good(x: np.ndarray, good: np.ndarray, share: float = RARE) -> np.ndarray:
    """The good rows, and of the others, spread evenly, no more than ``share`` of them: anomalies must be few for splits to isolate them."""
    bad = np.flatnonzero(~good)
    few = max(1, int(share * good.sum()))
    return x[np.sort(np.concatenate([np.flatnonzero(good), bad[:: max(1, -(-len(bad) // few))]]))] if len(x) else x


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int, make: Callable[[list[bytes]], np.ndarray], value: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """``make`` of the texts of at most ``most`` labelled ids, least by a hash, and their labels; nulls are left out.

    Of rows that share an id the least text counts. Texts become numbers on the executors, so that
    what comes to the driver is bounded in bytes too.
    """
    few = labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(value).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_t")).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_t").alias("_t"))

    def run(batches):
        for batch in batches:
            every = batch.column(2).to_pylist()
            for a, b in chunks(every):
                x = np.asarray(make(every[a:b]), dtype=np.float64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), flat], names=["_id", "_y", "x"])

    kind = dict(texts.dtypes)["_id"]
    got = texts.mapInArrow(run, f"_id {kind}, _y int, x array<double>").toArrow().sort_by([("_id", "ascending"), ("_y", "ascending")])
    width = np.asarray(make([b""])).shape[1]
    return got["x"].combine_chunks().flatten().to_numpy().reshape(-1, width) if got.num_rows else np.zeros((0, width)), got["_y"].to_numpy()


def _rule_row(texts: list[bytes]) -> np.ndarray:
    """What the forest splits on, and whether the base rules fail."""
    s = statistics(texts)
    return np.concatenate([features(s), base_failed(s)[:, None]], axis=1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Forest, float]:
    """The forest, and its cut, from at most ``sample`` labelled rows."""
    x, y = labelled_rows(docs, labels, sample, _rule_row)
    ok = x[:, -1] == 0
    x, good = x[ok, :-1], y[ok] == 1
    if not len(x):
        return Forest(x), 2.0
    forest = Forest(mostly_good(x, good))
    return forest, calibrate(forest.score(x), good)


def quality_rules(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``carry`` columns of each row and its statistics, base_failed, anomaly (double) and kept.

    A null or empty text has no words and so fails; equal texts get equal verdicts. No rows give no
    rows. Other columns of ``docs``, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    forest, cut = fit(docs, labels, sample)
    keep = list(dict.fromkeys((*carry, text_col)))
    names = list(carry)

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            s, failed, score = {k: np.zeros(len(texts), dtype=np.int64) for k in BASE}, np.zeros(len(texts), dtype=bool), np.zeros(len(texts))
            for a, b in chunks(texts):
                part = statistics(texts[a:b])
                for k in BASE:
                    s[k][a:b] = part[k]
                failed[a:b], score[a:b] = base_failed(part), forest.score(features(part))
            yield with_columns(batch, names, {k: pa.array(v) for k, v in s.items()} | {"base_failed": pa.array(failed), "anomaly": pa.array(score), "kept": pa.array(~failed & (score < cut))})

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{k} {v}" for k, v in BASE.items()] + ["base_failed boolean, anomaly double, kept boolean"])
    return docs.select(*keep).mapInArrow(run, schema)
