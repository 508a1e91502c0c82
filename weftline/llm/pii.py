"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base matches (exact patterns and checks) always stay. Wider patterns propose further spans of the
same kinds; regex, gazetteer and context labelers vote on every span, base or proposed. Votes of
all documents are counted by pattern, of which there are few; expectation-maximisation estimates
from the counts how reliable each labeler is. A logistic classifier of spans is trained on the
posteriors, weighted by count: it sees, besides the votes, the span (its length, digits, separators,
alphabet) and its context (the characters and the line around it). Proposed spans that it accepts are added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
#: Posterior above which a proposed span is added.
ACCEPT = 0.5
#: Fixed: the base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits are taken whole: a match cannot begin inside a run of them, as it would also begin at its start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\[at\]|\(at\)").search

#: Wider patterns that propose spans.
_WIDER = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[\w-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]{2,63}){1,5}(?![\w-])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![\w.+-])[3-6](?:[0-9]{3}(?:[ ./_-]{1,2}[0-9]{4}){3}|[0-9]{13,18})(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\+?[0-9]{1,3} ?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])|(?<![\w.+-])00[1-9][0-9]{8,12}(?![\w-])"),
}
#: Gazetteers: what begins or ends such data.
_ENDINGS = frozenset("com org net edu gov io de fr es uk info eu".split())
_CUES = {"email": re.compile(r"(?i)\b(?:e-?mail|mailto|contact|write to)\b"), "ip": re.compile(r"(?i)\b(?:ip|host|server|addr(?:ess)?)\b"), "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|payment)\b"), "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell)\b")}
_NOT = re.compile(r"(?i)(?:\bversion|\bv|\bsection|\bchapter|\border|\binvoice|\bisbn|#|=)\s?[\"']?$")
LABELERS = ("strict", "shape", "gazetteer", "alone", "cue", "not_a_number")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left and right; linear, as no local part reaches past the @ before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base match, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) < 20 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that no base span, and no earlier proposal, overlaps."""
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in _WIDER[kind].finditer(text))
    taken, out = sorted((a, b) for a, _, b in base), []
    for a, k, b in found:
        if all(b <= x or a >= y for x, y in taken):
            out.append((a, k, b))
            taken.append((a, b))
    return out


def votes(text: str, span: tuple[int, int, int], strict: bool) -> str:
    """One character a labeler: 1 for, 0 against, - abstains."""
    a, k, b = span
    s, before, after = text[a:b], text[max(0, a - 48) : a], text[b : b + 16]
    digits = [c for c in s if c.isdigit()]
    shape = "1" if (k == 0 and s.count("@") == 1 or k == 1 and s.count(".") == 3 or k == 2 and 14 <= len(digits) <= 19 or k == 3 and (s[0] == "+" or len(digits) in (10, 11))) else "0"
    if k == 0:
        known = "1" if re.split(r"[^A-Za-z]+", s.lower())[-1] in _ENDINGS else "0"
    elif k == 1:
        known = "-" if ":" in s else "0" if s.startswith(("0.", "255.")) else "1"
    elif k == 2:
        known = "1" if digits[0] in "3456" and luhn("".join(digits)) else "0"
    else:
        known = "1" if s[0] == "+" or digits[0] in "23456789" else "0"
    alone = "1" if (not before or before[-1].isspace() or before[-1] in "(<\"':") and (not after or after[0].isspace() or after[0] in ".,;:!?)>\"'") else "0"
    cue = "1" if _CUES[KINDS[k]].search(before) else "-"
    number = "0" if _NOT.search(before) else "-" if k != 2 else "1" if len(set(digits)) > 2 else "0"
    return ("1" if strict else "0") + shape + known + alone + cue + number


def _side(c: str) -> str:
    """The class of a character beside a span: none, line end, blank, letter, digit, opening or closing mark, other."""
    return "e" if not c else "n" if c == "\n" else "b" if c.isspace() else "a" if c.isalpha() else "d" if c.isdigit() else "o" if c in "([{<\"':=" else "c" if c in ")]}>.,;!?" else "x"


def shape(text: str, span: tuple[int, int, int]) -> str:
    """One character for each feature of a span and its context: length, share of digits, separators, letters, the characters before and after, its place in the line."""
    a, _, b = span
    s = text[a:b]
    digits, marks = sum(c.isdigit() for c in s), sum(not c.isalnum() for c in s)
    before, after = text.rfind("\n", max(0, a - 200), a), text.find("\n", b, b + 200)
    place = ("1" if before == a - 1 or a == 0 else "0") + ("1" if after == b or b == len(text) else "0")
    return f"{min(len(s) // 6, 5)}{4 * digits // len(s)}{min(marks, 6)}{'u' if s != s.lower() else 'l' if any(c.isalpha() for c in s) else '-'}{_side(text[a - 1 : a] if a else '')}{_side(text[b : b + 1])}{place}"


def scan(text: str) -> list[tuple[tuple[int, int, int], str]]:
    """Every base and proposed span with its votes and, behind a bar, its features."""
    if not _ANY(text):
        return []
    base = base_spans(text)
    return [(s, f"{votes(text, s, True)}|{shape(text, s)}") for s in base] + [(s, f"{votes(text, s, False)}|{shape(text, s)}") for s in proposals(text, base)]


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(vote 1 | true), P(vote 1 | false) of each labeler, posteriors, and the prior.

    Labelers that abstain say nothing. The strict labeler starts as the most trusted one, which
    settles which of the two classes is called true.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([[{"1": 1.0, "0": 0.0, "-": np.nan}[c] for c in k[1]] for k in keys]).reshape(len(keys), len(LABELERS))
    said = ~np.isnan(v)
    v0 = np.nan_to_num(v)
    yes, no, prior = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.3), 0.5
    yes[0], no[0] = 0.95, 0.05
    p = np.zeros(len(keys))
    for _ in range(rounds):
        like = (np.where(said, v0 * np.log(yes / no) + (1 - v0) * np.log((1 - yes) / (1 - no)), 0)).sum(1) + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(like, -40, 40)))
        for w, rate, start in ((p * n, yes, 0.8), ((1 - p) * n, no, 0.3)):
            mass = (w[:, None] * said).sum(0)
            rate[:] = np.clip(((w[:, None] * v0 * said).sum(0) + 2 * start) / (mass + 2), 0.02, 0.98)
        no[0] = min(no[0], yes[0] / 2)
        prior = float(np.clip((p @ n + 1) / (n.sum() + 2), 0.05, 0.95))
    return yes, no, p, prior


def _features(kind: int, pattern: str, names: dict[tuple[int, str], int]) -> list[float]:
    """Kind, votes, and one place for each value of each feature of span and context that was met."""
    said, seen = pattern.split("|")
    f = [1.0, *(float(kind == k) for k in range(len(KINDS)))]
    for c in said[1:]:  # what the strict labeler says is settled for base spans; the classifier judges the rest
        f += [float(c == "1"), float(c == "0")]
    own = [0.0] * len(names)
    for place in enumerate(seen):
        own[names[place]] = 1.0
    return f + own


def train(counts: dict[tuple[int, str], int], rounds: int = 400) -> dict[tuple[int, str], float]:
    """P(personal) of every pattern of votes and features by a logistic classifier trained on EM's posteriors of the votes."""
    if not counts:
        return {}
    keys, said = sorted(counts), Counter()
    for (k, s), n in counts.items():
        said[k, s.split("|")[0]] += n
    belief = dict(zip(sorted(said), reliabilities(said)[2].tolist(), strict=True))
    y = np.array([belief[k, s.split("|")[0]] for k, s in keys])
    names = {f: i for i, f in enumerate(sorted({f for _, s in keys for f in enumerate(s.split("|")[1])}))}
    x = np.array([_features(k, s, names) for k, s in keys])
    w = np.array([counts[k] for k in keys], dtype=float)
    w /= w.sum()
    b = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - 1e-4 * b
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(b)), grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", redact: bool = False) -> DataFrame:
    """``carry`` columns of each row, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Spans print as kind:start:end (code points, end exclusive), in order, joined by commas. A null
    or empty text has none. With ``redact`` the text column, if carried, holds ``<EMAIL>`` and so
    on in place of the spans (of overlapping ones, in place of all that they cover). Repeated rows give equal results;
    without any span no classifier is trained; no rows give none.
    """
    small_batches(docs.sparkSession, 5000)
    types, names = dict(docs.dtypes), list(carry)

    def count(batches):
        for batch in batches:
            seen: dict[tuple[int, str], int] = {}
            for text in batch.column(0).to_pylist():
                for (_, k, _), pattern in scan(text or ""):
                    seen[k, pattern] = seen.get((k, pattern), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([p for _, p in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "n"])

    counted = docs.select(text_col).mapInArrow(count, "kind int, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    model = train({(r[0], r[1]): r[2] for r in counted.collect()})  # votes and features take few values each, so patterns are bounded whatever the table

    def run(batches):
        for batch in batches:
            n, sha, spans, shown = [[] for _ in KINDS], [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                found = scan(text or "")
                base = sorted(s for s, p in found if p[0] == "1")
                every = sorted(base + [s for s, p in found if p[0] == "0" and model.get((s[1], p), 0.0) >= ACCEPT])
                for k in range(len(KINDS)):
                    n[k].append(sum(s[1] == k for s in base))
                show = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)
                sha.append(hashlib.sha256(show(base).encode()).hexdigest())
                spans.append(show(every))
                if redact:
                    shown.append(None if text is None else replace(text, every))
            new = {f"n_{k}": pa.array(v, pa.int64()) for k, v in zip(KINDS, n, strict=True)} | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.string())}
            out = with_columns(batch, names, new)
            yield out.set_column(names.index(text_col), text_col, pa.array(shown, pa.string())) if redact and text_col in names else out

    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"n_{k} long" for k in KINDS] + ["base_sha256 string, spans string"])
    return docs.select(*dict.fromkeys((*names, text_col))).mapInArrow(run, schema)


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = b
        elif b > at:  # reaches past the spans before it
            out.append(f"<{KINDS[k].upper()}>")
            at = b
    return "".join(out) + text[at:]
