"""Streams of Markdown cut into finished blocks as their pieces arrive.

A code block ends after its closing fence, other text before an opening fence or after an empty
line; without Markdown every line is a block. What is cut depends on where the pieces end, so the
pieces of one stream are folded in order: a stream is one answer of a model and fits in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed: what opens a code block, what closes it, and what ends a paragraph.
_OPEN, _CLOSE, _GAP = re.compile(r"```[A-Za-z0-9_]*\n"), "\n```\n", re.compile(r"\n[\s\ufeff]*\n")
BLOCK = "pos int, text string, is_code boolean"


def cut(held: str, coded: bool, markdown: bool = True) -> tuple[list[tuple[str, bool]], str, bool]:
    """The finished blocks of a buffer with whether each is code, what is left of it, and whether that is code."""
    out: list[tuple[str, bool]] = []
    at = 0
    while True:
        opened = _OPEN.search(held, at) if markdown and not coded else None
        coded = coded or opened is not None and opened.start() == at
        if not markdown:
            end = held.find("\n", at) + 1
        elif coded:
            found = held.find(_CLOSE, at)
            end = found + len(_CLOSE) if found >= 0 else 0
        elif opened:
            end = opened.start()
        else:
            end = m.end() if (m := _GAP.search(held, at)) else 0
        if not end:
            return out, held[at:], coded
        out.append((held[at:end], coded))
        at, coded = end, False


def fold_blocks(pieces: DataFrame, key: str, order: str, text: str, markdown: bool = True) -> DataFrame:
    """(key, pos, text, is_code): the blocks of each stream, its last one as its pieces end. Null pieces add nothing; a stream without text has no block."""
    kind = dict(pieces.dtypes)[key]

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, coded, blocks = "", False, []
        for piece in pdf.sort_values("o", kind="stable")["t"].dropna():
            new, held, coded = cut(held + piece, coded, markdown)
            blocks += new
        if held:
            blocks.append((held, coded))
        return pd.DataFrame([(*group, i, *b) for i, b in enumerate(blocks)], columns=[key, "pos", "text", "is_code"])

    rows = pieces.select(pieces[key].alias(key), pieces[order].alias("o"), pieces[text].alias("t"))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, {BLOCK}")


def blocks_live(pieces: DataFrame, markdown: bool = True) -> DataFrame:
    """A streaming DataFrame (request_id, seq, text) to blocks as they finish; a null text ends its stream and gives what is left.

    State holds the unfinished block alone, and the number of the next one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, coded, at = state.get if state.exists else ("", False, 0)
        rows, ended = [], False
        for piece in pd.concat(list(frames)).sort_values("seq", kind="stable")["text"]:
            ended = pd.isna(piece)
            if ended:
                break
            new, held, coded = cut(held + piece, coded, markdown)
            rows += new
        if ended and held:
            rows.append((held, coded))
        if not ended:
            state.update((held, coded, at + len(rows)))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame([(*key, at + i, *b) for i, b in enumerate(rows)], columns=["request_id", "pos", "text", "is_code"])

    return pieces.groupBy("request_id").applyInPandasWithState(run, f"request_id string, {BLOCK}", "held string, coded boolean, at int", "append", GroupStateTimeout.NoTimeout)
