"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The frequent words of the corpus (counted over all of it) are cut into pieces, merged once on the
driver, and compiled into an automaton whose equal suffixes are shared. Each arc carries how many
words precede it, so that a walk sums up to the word's rank, the row of its ids. The arrays are
broadcast (``LEXICON`` words bound their size), written to an unlinked temporary file and
memory-mapped by each worker. Distinct words of a block of texts walk it all at once; words that
it lacks are cut into pieces and merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import Stage, chunks, count_words, frequent_words, small_batches, with_columns

#: Frequent words in the transducer, at most, and the longest of them in bytes.
LEXICON, LONGEST = 32_768, 48
#: Fixed: how byte-level BPE cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed: bytes that a byte-level vocabulary shows as themselves; the others stand as letters from U+0100 on, in order.
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if visible, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: token bytes by id, merge ranks, added tokens."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = byte_letters()
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t in self.added:
            self.ids.pop(t.encode(), None)
        self.ranks = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((to_bytes(a), to_bytes(b)), k)
        self.bytes = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.added.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of least rank, leftmost first, merged until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        get = self.ranks.get
        while len(parts) > 1:
            best, at = min((get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same by a heap and links, for pieces whose quadratic cost would show."""
        import heapq

        get, n = self.ranks.get, len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p, ok in zip(parts, live, strict=True) if ok]


def compile_transducer(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the entries' keys, in arrays, and their ids by rank.

    Built from sorted keys: the states of the last key that the next one leaves are replaced by
    equal ones met before. ``arcs`` holds state * 256 + byte, sorted; ``to`` and ``skip`` the arc's
    target and how many words come before those through it.
    """
    words = sorted(entries)
    states: list[list] = [[False, {}]]  # final, arcs
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = states[state][1][byte]
            key = (states[child][0], tuple(states[child][1].items()))
            states[state][1][byte] = register.setdefault(key, child)

    last = b""
    for w in words:
        same = next((i for i, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        settle(same)
        at = states[path[-1][0]][1][path[-1][1]] if path else 0
        for byte in w[same:]:
            states.append([False, {}])
            states[at][1][byte] = len(states) - 1
            path.append((at, byte))
            at = len(states) - 1
        states[at][0], last = True, w
    settle(0)
    number, order, counts = {0: 0}, [0], {}
    for s in order:  # reachable states, breadth first
        for t in states[s][1].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)

    def count(s: int) -> int:
        if s not in counts:
            counts[s] = states[s][0] + sum(count(t) for t in states[s][1].values())
        return counts[s]

    arcs, to, skip = [], [], []
    for s in order:
        before = int(states[s][0])
        for byte, t in states[s][1].items():  # bytes ascend, as words are sorted
            arcs.append(number[s] * 256 + byte), to.append(number[t]), skip.append(before)
            before += count(t)
    ids = [entries[w] for w in words]
    return {"arcs": np.array(arcs, dtype=np.int64), "to": np.array(to, dtype=np.int32), "skip": np.array(skip, dtype=np.int32), "final": np.array([states[s][0] for s in order], dtype=np.uint8), "starts": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([x for row in ids for x in row], dtype=np.int32)}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    body = b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())
    return len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8) + body


def map_file(packed: bytes) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped from a temporary file that has no name and ends with the process."""
    f = tempfile.TemporaryFile()  # noqa: SIM115  the map keeps it
    f.write(packed)
    f.flush()
    view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(view[:8], "little")
    out, at = {}, 8 + n + -n % 8
    for k, kind, size in json.loads(view[8 : 8 + n]):
        out[k] = np.frombuffer(view, dtype=kind, count=size, offset=at)
        at += out[k].nbytes + -out[k].nbytes % 8
    return out


def look_up(t: dict[str, np.ndarray], pieces: list[bytes]) -> np.ndarray:
    """The rank of each piece in the transducer or -1; all pieces step through it together."""
    rank = np.full(len(pieces), -1, dtype=np.int64)
    if not len(t["arcs"]) or not pieces:
        return rank
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    flat, start = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(size) - size
    rows = np.flatnonzero((size > 0) & (size <= LONGEST))
    state, total = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for step in range(LONGEST + 1):
        done = size[rows] == step
        if done.any():
            good = done & (t["final"][state] == 1)
            rank[rows[good]] = total[good]
            rows, state, total = rows[~done], state[~done], total[~done]
        if not len(rows):
            break
        want = state * 256 + flat[start[rows] + step]
        at = np.minimum(np.searchsorted(t["arcs"], want), len(t["arcs"]) - 1)
        ok = t["arcs"][at] == want
        rows, at = rows[ok], at[ok]
        state, total = t["to"][at].astype(np.int64), total[ok] + t["skip"][at]
    return rank


#: White space on both sides of a space, or before a space that ends the text.
_WIDE = re.compile(r"\s (?:\s|\Z)").search


class Encoder:
    """Encodes texts by the transducer, merging what it lacks; decodes ids by the vocabulary."""

    def __init__(self, vocabulary: Vocabulary, arrays: dict[str, np.ndarray]):
        import regex
        import tiktoken

        self.v, self.t = vocabulary, arrays
        self.find = regex.compile(PIECES).findall
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(vocabulary.added, key=len, reverse=True)) + ")").split if vocabulary.added else None
        # merges outside the lexicon run in compiled code where ids follow the merges' ranks, as they must for ranks alone to do
        by_rank = all(self.v.ids.get(a + b) == 256 + k for (a, b), k in self.v.ranks.items())
        self.merge = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=self.v.ids, special_tokens={})._core_bpe.encode_single_piece if by_rank else self.v.merge
        most = max(self.v.bytes, default=-1) + 1
        self.token = [self.v.bytes.get(i, b"") for i in range(most)]

    def pieces(self, text: str) -> list:
        """Pieces as strings, and ids for added tokens."""
        if self.split is None or not any(x in text for x in self.v.added):
            return self.find(text)
        out: list = []
        for k, part in enumerate(self.split(text)):
            out += [self.v.added[part]] if k % 2 else self.find(part)
        return out

    def block(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """For each text the numbers of its parts; for each number the part's ids.

        A part is what stands between two spaces, with the space before it: no piece crosses the
        start of such a part unless white space also stands on both sides of that space, so other
        texts are cut whole. Parts of frequent words come out of the transducer as they are.
        """
        number: dict = {}
        put, rows = number.setdefault, []
        for text in texts:
            if _WIDE(text) or self.split is not None and any(x in text for x in self.v.added):
                rows.append([put((p,), len(number)) for p in self.pieces(text)])
            else:
                first, *rest = text.split(" ")
                row = [put((p,), len(number)) for p in self.find(first)] if first else []
                row += [put(p, len(number)) for p in rest]
                rows.append(row)
        keys = list(number)
        raw = [b" " + k.encode() if isinstance(k, str) else k[0].encode() if isinstance(k[0], str) else b"" for k in keys]
        starts, ids, merge, find = self.t["starts"], self.t["ids"], self.merge, self.find
        found = []
        for k, b, r in zip(keys, raw, look_up(self.t, raw).tolist(), strict=True):
            if r >= 0:
                found.append(ids[starts[r] : starts[r + 1]].tolist())
            elif isinstance(k, str):
                new: list[int] = []
                for p in find(" " + k):
                    new += merge(p.encode())
                found.append(new)
            else:
                found.append([k[0]] if isinstance(k[0], int) else merge(b))
        return rows, found

    def encode(self, texts: list[str]) -> list[list[int]]:
        rows, found = self.block(texts)
        return [[i for p in row for i in found[p]] for row in rows]

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(count, digest of the ids, digest of the text decoded from them) of each text; each part's ids are printed and turned to bytes once."""
        rows, found = self.block(texts)
        token, sha = self.token, hashlib.sha256
        size = [len(x) for x in found]
        shown = [",".join(map(str, x)) for x in found]
        back = [b"".join([token[i] for i in x]) for x in found]
        return [(sum([size[p] for p in row]), sha(",".join([shown[p] for p in row]).encode()).hexdigest(), sha(b"".join([back[p] for p in row]).decode("utf-8", "replace").encode()).hexdigest()) for row in rows]


def corpus_words(docs: DataFrame, most: int = LEXICON, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, at most ``most`` and shorter than LONGEST bytes, sorted."""
    counts = Stage(count_words(docs.select(text_col), False), "words")
    found = sorted(w.decode() for w in frequent_words(counts.df, most, LONGEST - 1))
    counts.drop()
    return found


def build_lexicon(vocabulary: Vocabulary, words: list[str]) -> dict[str, np.ndarray]:
    """The transducer of the words as they stand after a space."""
    import regex

    find, entries = regex.compile(PIECES).findall, {}
    for w in words:
        entries[(" " + w).encode()] = [i for p in find(" " + w) for i in vocabulary.merge(p.encode())]
    return compile_transducer(entries)


def encode_decode(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", lexicon: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """``carry`` columns of each row, n_tokens, ids_sha256 and decoded_sha256 (and token_ids).

    A null or empty text has no ids. Added tokens in a text are found first, as the file says; no
    other special token is added. Texts of any length are encoded whole. Repeated rows give equal
    results; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    raw = open(tokenizer_path, "rb").read()  # noqa: SIM115
    vocabulary = Vocabulary(raw)
    sent = docs.sparkSession.sparkContext.broadcast((raw, pack(build_lexicon(vocabulary, corpus_words(docs, lexicon, text_col)))))
    names, state = list(carry), {}

    def run(batches):
        for batch in batches:
            if not state:
                spec, packed = sent.value
                state["encoder"] = Encoder(Vocabulary(spec), map_file(packed))
            e: Encoder = state["encoder"]
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            n, a, b, all_ids = [], [], [], []
            for i, j in chunks(texts, 4_000_000):
                for count, ids, text in e.digests(texts[i:j]):
                    n.append(count), a.append(ids), b.append(text)
                if with_ids:
                    all_ids += e.encode(texts[i:j])
            new = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield with_columns(batch, names, new | ({"token_ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {}))

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["token_ids array<int>"] * with_ids)
    return docs.select(*dict.fromkeys((*carry, text_col))).mapInArrow(run, schema)
