"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its bytes, hashed byte pairs, word shapes and bands of repetition, over the whole
text. A bounded sample of labelled rows (``SAMPLE``) gives inverse document frequencies, the leading
singular directions and their unit vectors, which are broadcast with their labels. Each document is
projected and compared with all of them by exact cosines, block by block; its ``NEIGHBOURS`` nearest
vote with a weight that grows with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, crc_mod, small_batches, text_bytes, with_columns
from weftline.llm.quality_rules import labelled_rows, statistics

#: Labelled rows that are broadcast, at most; directions kept; voters; weight's steepness.
SAMPLE, RANK, NEIGHBOURS, STEEP = 6000, 48, 25, 12.0
PAIRS, BANDS = 1024, 12
#: Share of the label 1 above which a row is predicted 1.
CUT = 0.7
_SHAPE = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _SHAPE[_b] = 0 if _b in (9, 10, 11, 12, 13, 32) else 1 if "a" <= _c <= "z" or _b > 127 else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else 4
TERMS = 256 + PAIRS + 25 + 7 * BANDS


def term_rows(texts: list[bytes]) -> np.ndarray:
    """One row of term weights for each text: log-scaled rates of bytes, pairs and shapes, and soft bands of rule ratios."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    s = statistics(texts)
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    ratios = np.stack([s["n_repeat_words"] / words, s["n_same_next"] / words, s["n_upper"] / chars, s["n_marks"] / words / 2, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_distinct"] / words], axis=1)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, dtype=np.uint8)
        if not len(b):
            continue
        wide, shape = b.astype(np.int32), _SHAPE[b]
        out[i, :256] = np.bincount(b, minlength=256) / len(b)
        out[i, 256 : 256 + PAIRS] = np.bincount((wide[:-1] * 31 + wide[1:] * 7) % PAIRS, minlength=PAIRS) / len(b)
        out[i, 256 + PAIRS : 281 + PAIRS] = np.bincount(shape[:-1] * 5 + shape[1:], minlength=25) / len(b)
    out[:, : 281 + PAIRS] = np.log1p(200 * out[:, : 281 + PAIRS])
    centres = np.linspace(0, 1, BANDS)
    near = np.maximum(0, 1 - np.abs(np.clip(ratios, 0, 1)[:, :, None] - centres) * (BANDS - 1))
    out[:, 281 + PAIRS :] = (6 * near).reshape(len(texts), -1)
    out[s["n_words"] == 0] = 0
    return out


class Space:
    """Latent-semantic directions of a sample's term rows, its unit vectors and labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        x = x.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1 if len(x) else np.ones(TERMS, dtype=np.float32)
        x = x * self.idf
        self.mean = x.mean(0) if len(x) else np.zeros(TERMS, dtype=np.float32)
        x = x - self.mean
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if len(x) else (0, np.eye(TERMS))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.labels = np.array(labels, dtype=np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.units = self._unit(x @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1)[:, None], 1e-9)

    def score(self, texts: list[bytes], neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """The weighted share of label 1 among each text's nearest neighbours, and all as near as the last of them; 0.5 without labels, else 0 for no words."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        x = term_rows(texts)
        empty = ~x.any(axis=1)
        v = self._unit((x * self.idf - self.mean) @ self.axes)
        out, k = np.zeros(len(texts)), min(neighbours, len(self.labels))
        for a in range(0, len(texts), block):
            cos = v[a : a + block] @ self.units.T
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            w = np.exp(STEEP * (cos - cos.max(1)[:, None]).astype(np.float64), where=cos >= last, out=np.zeros(cos.shape))
            out[a : a + block] = (w @ self.labels + 0.5 * self.prior) / (w.sum(1) + 0.5)
        out[empty] = 0.0
        return out


def score_quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``carry`` columns of each row, held_out, score (0 to 1) and predicted.

    Learns from at most ``sample`` labelled rows with crc32(doc_id) mod 4 other than 2, least by a
    hash of the id. Without labels every score is 0.5; else null and empty texts score 0. Neighbours
    that tie with the last one vote too. Null ids are scored and are not held out. Repeated rows get equal scores; no rows give none. Nothing but the
    text enters a score.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Space(*labelled_rows(docs, labels.where(crc_mod("doc_id", 4) != 2), sample, term_rows)))
    names, types = list(carry), dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            score = np.concatenate([sent.value.score(texts[a:b]) for a, b in chunks(texts)] or [np.zeros(0)])
            yield with_columns(batch, [*names, "held_out"], {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= CUT).astype(np.int32))})

    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["held_out boolean, score double, predicted int"])
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(*dict.fromkeys((*names, text_col)), held).mapInArrow(run, schema)
