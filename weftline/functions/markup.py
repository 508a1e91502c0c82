"""Plain text from Markdown, display width and wrapping: rules that read a text line by line, as pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

_ITEM = re.compile(r"^(\s*)(?:([-*•])|(\d+)\.)\s+(.*)$")
_LINK, _CODE = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), re.compile(r"`([^`\n]+)`")
_BOLD, _ITALIC = re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*"), re.compile(r"\*(?=\S)([^*\n]+?)(?<=\S)\*")
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def plain_inline(line: str) -> str:
    """Without the marks of bold, italic, code and links; escaped characters stand for themselves."""
    held: list[str] = []
    line = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|>])", lambda m: held.append(m[1]) or f"\x00{len(held) - 1}\x00", line)
    for mark in (_CODE, _LINK, _BOLD, _ITALIC):
        line = mark.sub(r"\1", line)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], line)


def plain_text(text: str) -> str:
    """Blocks as plain lines: no heading hashes or fences, bullets as '- ', lists numbered on from their start, table cells between bars, a blank line between blocks."""
    blocks: list[list[str]] = []
    kind, fenced, number = None, False, 0

    def put(new: str, line: str) -> None:
        nonlocal kind
        if new != kind or not blocks:
            blocks.append([])
        kind = new
        blocks[-1].append(line)

    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced, kind = not fenced, None
        elif fenced:
            put("code", line)
        elif not line.strip():
            kind = None
        elif line.startswith("#"):
            if m := re.match(r"#{1,6}\s+(.*)", line):
                kind = None
                put("heading", plain_inline(m[1]))
                kind = None
        elif line.lstrip().startswith(">"):
            put("quote", plain_inline(re.sub(r"^\s*(?:>\s?)+", "", line)))
        elif line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1:
            cells = [c.strip() for c in line.strip()[1:-1].split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                put("table", " | ".join(plain_inline(c) for c in cells))
        elif m := _ITEM.match(line):
            if m[3]:
                number = number + 1 if kind == "ordered" else int(m[3])
                put("ordered", f"{m[1]}{number}. {plain_inline(m[4])}")
            else:
                put("list", f"{m[1]}- {plain_inline(m[4])}")
        else:
            put("list" if kind in ("list", "ordered") and line[0].isspace() else "text", plain_inline(line.strip() if kind != "list" else line))
    return "\n\n".join("\n".join(b) for b in blocks)


def display_width(text: str) -> int:
    """Terminal columns: control characters and colour codes none, tabs 8, wide characters and emoji 2, marks none."""
    if text.isascii() and text.isprintable():
        return len(text)
    import regex

    total = 0
    for cluster in regex.findall(r"\X", _ANSI.sub("", text)):
        c = cluster[0]
        if c == "\t":
            total += 8
        elif unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me"):
            continue
        elif len(cluster) > 1 and regex.match(r"\p{Emoji_Presentation}|\p{Regional_Indicator}|\p{Extended_Pictographic}", cluster) or unicodedata.east_asian_width(c) in "WF":
            total += 2
        else:
            total += 1
    return total


def wrap(text: str, width: int = 40) -> list[str]:
    """Lines of at most so many columns, cut at spaces, and inside words only where one is too long; '' has none. Word bounds are approximate."""
    import regex

    out = []
    for line in text.split("\n") if text else []:
        now, used = "", 0
        for word in re.findall(r"\s+|\S+", line):
            size = display_width(word)
            if used + size <= width:
                now, used = now + word, used + size
                continue
            if now.strip():
                out.append(now.rstrip())
            now, used = "", 0
            if word.isspace():
                continue
            for g in regex.findall(r"\X", word) if size > width else [word]:
                size = display_width(g)
                if now and used + size > width:
                    out.append(now)
                    now, used = "", 0
                now, used = now + g, used + size
        out.append(now.rstrip())
    return out


def fast_hash(text: str, seed: int = 0) -> str:
    """A 53-bit hash of UTF-16 units in hexadecimal: two 32-bit lanes, mixed by fixed odd factors."""
    # fixed values of the hash
    start, step, last = (0xDEADBEEF, 0x41C6CE57), (2654435761, 1597334677), (2246822507, 3266489909)
    mask = 0xFFFFFFFF
    a, b = start[0] ^ seed, start[1] ^ seed
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        unit = raw[i] | raw[i + 1] << 8
        a, b = (a ^ unit) * step[0] & mask, (b ^ unit) * step[1] & mask
    x = (a ^ a >> 16) * last[0] & mask ^ (b ^ b >> 13) * last[1] & mask
    y = (b ^ b >> 16) * last[0] & mask ^ (x ^ x >> 13) * last[1] & mask
    return format((y & 0x1FFFFF) << 32 | x, "x")


def _series(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


strip_markdown = lambda c: _series(plain_text, "string")(c)
string_width = lambda c: _series(display_width, "long")(c)
wrapped = lambda c, width=40: _series(lambda t: wrap(t, width), "array<string>")(c)
hashed = lambda c: _series(fast_hash, "string")(c)


def side_by_side(left, right, width: int = 40, wide=False):
    """Both texts wrapped, padded to the width and joined by ' - ', as lines. Where ``wide`` (of the left file: whether it has any wide character), pads are ideographic spaces."""

    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, y, full in zip(a.fillna(""), b.fillna(""), w, strict=True):
            p, q = wrap(x, width) or [""], wrap(y, width) or [""]
            n = max(len(p), len(q))
            p, q = p + [""] * (n - len(p)), q + [""] * (n - len(q))
            gaps = [max(0, width - display_width(s)) for s in p]
            out.append([s + ("\u3000" * (g // 2) + " " * (g % 2) if full else " " * g) + " - " + t for s, g, t in zip(p, gaps, q, strict=True)])
        return pd.Series(out)

    return run(left, right, F.lit(wide) if isinstance(wide, bool) else wide)


def count_tokens(column, tokenizer_json: str):
    """Tokens of a tokenizer file; the file's bytes are sent to the workers, which load them once."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    held: list = []

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_str(spec))
        return pd.Series([len(e.ids) for e in held[0].encode_batch(s.fillna("").tolist())])

    return run(column)
