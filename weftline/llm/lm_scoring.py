"""Language-model scores: a self-attention model over subword ids, and a unigram base.

Words of all training texts are counted by a distributed aggregation. Their subword ids are bytes
and pieces merged from them (a word's last piece carries the word's end), learnt from the frequent
words' counts, so that any text has a probability; without training words they are the commonest
pieces of a public tokenizer. Every text is cut into pieces once, and training and scoring read
what was written. The model is trained on every window of all
training texts, whatever their length, once: in rounds that take growing shares of the rows, every
task trains on its own windows from the same start, and the tasks' weights are averaged by windows.
Every text is cut into overlapping windows and each of its tokens scored once; a text's score is
the sum of its tokens' log10 probabilities, which the model sums to one over all next tokens. The
most frequent words (``TOP`` at most, broadcast) give most counts of the base; the others meet
theirs in a join by word.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import HELD_WORDS, Stage, chunks, crc_mod, frequent_words, small_batches, text_bytes
from weftline.llm.lm_model import VOCABULARY, Model, keep_memory

#: Words that are broadcast, at most, and their length in bytes.
TOP, LONGEST = 262_144, 64
#: Where rounds of training end, in sixteenths of the rows; the rates of the rounds; slices that weights are averaged in.
ROUNDS, RATES, SLICES = (1, 2, 4, 8, 16), (0.01, 0.006, 0.004, 0.002, 0.001), 16
#: Bytes of texts that are cut together.
CUT_TOGETHER = 8_000_000
#: Bytes of written pieces (two each) that are trained on or scored together.
TOGETHER = 1_000_000
#: Remainder of crc32(doc_id) that is held out.
FOLDS, HELD_OUT = 7, 2
END = 256  # after the 256 bytes
#: Fixed: the mark of a word's end in the vocabulary file; a space stands for it here.
WORD_END = "</w>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a BPE file with word ends, a space in place of the end mark; ids follow the merges' ranks."""
    import json

    from weftline.llm.bpe import byte_letters

    letters = byte_letters()
    with open(path, "rb") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = {}
    for token, i in vocab.items():
        ends = token.endswith(WORD_END)
        bare = token[: -len(WORD_END)] if ends else token
        if all(c in letters for c in bare):
            out[bytes(letters[c] for c in bare) + b" " * ends] = i
    return out


def learn_merges(words: dict[bytes, int], most: int) -> list[bytes]:
    """Byte pairs merged by their counts in words and their ends, ``most`` pieces at most.

    Pairs that cannot overlap in a word and stand at least half as often as the commonest are merged in one pass.
    """
    pieces, side = [bytes([i]) for i in range(END)], END + most
    known = {w: i for i, w in enumerate(pieces)}
    units = np.frombuffer(b"".join(w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    weight = np.repeat(np.fromiter(words.values(), dtype=np.float64, count=len(words)), np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)))
    last = units == ord(" ")
    while len(pieces) < side:
        here = np.flatnonzero(~last[:-1])
        pair = units[here] * side + units[here + 1]
        order = np.argsort(pair)
        kinds = pair[order]
        first = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]][: len(kinds)])
        if not len(first):
            break
        seen, kinds = np.add.reduceat(weight[here[order]], first), kinds[first]
        taken: dict[int, int] = {}
        lefts, rights, most_seen = set(), set(), seen.max()
        least = max(2, most_seen / 2)
        enough = np.flatnonzero(seen >= least)
        for k in kinds[enough[np.lexsort((kinds[enough], -seen[enough]))]].tolist():
            a, b = divmod(k, side)
            if a in rights or b in lefts or (taken and a == b):
                continue
            whole = pieces[a] + pieces[b]
            if whole not in known:
                if len(pieces) == side:
                    break
                known[whole] = len(pieces)
                pieces.append(whole)
            taken[k] = known[whole]
            lefts.add(a)
            rights.add(b)
            if a == b:
                break
        if not taken:
            break
        codes = np.sort(np.fromiter(taken, dtype=np.int64, count=len(taken)))
        near = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        hit = np.flatnonzero(codes[near] == pair)
        at, new = here[hit], np.array([taken[k] for k in codes.tolist()])[near[hit]]
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # of one unit's repetitions every second pair is merged
        every = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0
        at, new = at[every], new[every]
        units[at], last[at] = new, last[at + 1]
        left = np.ones(len(units), dtype=bool)
        left[at + 1] = False
        units, weight, last = units[left], weight[left], last[left]
    return pieces[END:]


class Pieces:
    """Reduced subword ids of words: bytes, the end, then the commonest pieces."""

    def __init__(self, ranks: dict[bytes, int], number: dict[int, int] | None = None):
        import tiktoken

        self.kept: dict[bytes, list[int]] = {}
        self.cut = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes = {v: k for k, v in ranks.items()}
        self.number = number or {}

    def choose(self, seen: dict[int, int], ends: int) -> np.ndarray:
        """Numbers the commonest of the counted pieces; how often each reduced id then stands, an end for each text."""
        best = sorted((i for i in seen if len(self.bytes[i]) > 1), key=lambda i: (-seen[i], i))[: VOCABULARY - END - 1]
        self.number = {i: END + 1 + k for k, i in enumerate(best)}
        self.kept.clear()
        counts = np.zeros(VOCABULARY)
        counts[END] = ends
        for i, n in seen.items():
            for k in (self.number[i],) if i in self.number else self.bytes[i]:
                counts[k] += n
        return counts

    def word(self, w: bytes) -> list[int]:
        """A word's ids; those of a bounded number of words are kept."""
        if (out := self.kept.get(w)) is None:
            if len(self.kept) > HELD_WORDS:
                self.kept.clear()
            out = self.kept[w] = self._word(w)
        return out

    def _word(self, w: bytes) -> list[int]:
        out: list[int] = []
        for i in self.cut(w + b" "):
            out += (self.number[i],) if i in self.number else self.bytes[i]
        return out


def count_words(texts: DataFrame, lower: bool) -> DataFrame:
    """``common.count_words``, counted by Arrow."""

    def run(batches):
        held, rows = [], 0

        def added():
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            v = pc.value_counts(_words(batch.column(0), lower)[0])
            held.append(pa.table({"word": v.field("values"), "c": v.field("counts")}))
            rows += len(v)
            if rows > 2 * HELD_WORDS:
                held = [added()]
                rows = len(held[0])
                if rows > HELD_WORDS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from added().to_batches()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(counts: DataFrame, pieces: Pieces) -> dict[int, int]:
    """How often each piece of the tokenizer stands in all counted words; at most a row for each piece comes back."""
    sent = counts.sparkSession.sparkContext.broadcast(ranks_of(pieces))

    def run(batches):
        cut, seen = Pieces(sent.value).cut, np.zeros(max(sent.value.values()) + 1, dtype=np.int64)
        for batch in batches:
            parts = [cut(w + b" ") for w in text_bytes(batch.column(0))]
            width = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            np.add.at(seen, np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=int(width.sum())), np.repeat(batch.column(1).to_numpy(), width))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found])], names=["piece", "n"])

    out = {r[0]: r[1] for r in counts.select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n")).collect()}
    sent.destroy()
    return out


def cut_documents(rows: DataFrame, pieces: Pieces, words: dict[bytes, int], ends: int) -> DataFrame:
    """For each (doc_id, text, held_out) its pieces as 16-bit numbers, its end last, and the base's sums; besides, a row (row, word, n) of each word that ``words`` lacks."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["doc_id"]
    sent = spark.sparkContext.broadcast((list(words), np.fromiter(words.values(), dtype=np.int64, count=len(words)), _laid(pieces, words), ends, ranks_of(pieces), pieces.number))
    state: dict = {}

    def run(batches):
        if not state:
            names, counts, laid, ends, *known = sent.value
            state.update(words=_strings(names), logs=np.log10(counts + 1.0), laid=laid, ends=ends, pieces=Pieces(*known))
            keep_memory()
        at = _row_ids()
        for batch in batches:
            ids, texts, held = batch.column(0), pc.fill_null(batch.column(1), ""), batch.column(2)
            for a, b in chunks([range(k) for k in pc.binary_length(texts).to_pylist()], CUT_TOGETHER):
                out, (tokens, lengths), rare = _cut_chunk(state, texts.slice(a, b - a))
                n, m = b - a, len(rare[0])
                row = np.arange(at, at + n)
                at += n
                nulls = {t: pa.nulls(m, t) for t in (ids.type, pa.bool_(), pa.int64(), pa.float64(), pa.binary())}
                stop = np.r_[0, 2 * np.cumsum(lengths)].astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(stop), pa.py_buffer(tokens)])
                cols = [
                    pa.concat_arrays([pa.array(row), pa.array(row[rare[0]])]), pa.concat_arrays([ids.slice(a, n), nulls[ids.type]]), pa.concat_arrays([held.slice(a, n), nulls[pa.bool_()]]),
                    *(pa.concat_arrays([pa.array(x), nulls[pa.int64()]]) for x in out[:2]), pa.concat_arrays([pa.array(out[2]), nulls[pa.float64()]]), pa.concat_arrays([cut, nulls[pa.binary()]]),
                    pa.concat_arrays([pa.nulls(n, pa.string()), rare[1]]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rare[2])]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "tokens", "word", "n"])

    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, tokens binary, word string, n long")


def read_tokens(cut: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of texts that were written, laid end to end, and how many each text has."""
    return np.frombuffer(b"".join(cut), dtype=np.uint16).astype(np.int64), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)) // 2


def train_round(train: DataFrame, pieces: Pieces, model: Model, rate: float) -> int:
    """Trains ``model`` on every window of ``train`` (written pieces, or else texts); how many there were.

    Each task starts from the model as it is and takes its own windows; the weights are averaged by
    windows, slice by slice, so that no task and not the driver meets those of all tasks.
    """
    sent, cut = train.sparkSession.sparkContext.broadcast((model, ranks_of(pieces), pieces.number)), "tokens" in train.columns

    def run(batches):
        keep_memory()
        (model, *known), part = sent.value, _row_ids() >> 33
        own, mine = None if cut else Pieces(*known), model.copy()
        texts = (t for batch in batches for t in [text_bytes(batch.column(0))])
        n = mine.learn((read_tokens(t[a:b]) if cut else tokens_of(own, t[a:b]) for t in texts for a, b in (chunks(t, TOGETHER) if cut else chunks(t))), rate, seed=part)
        if n:
            values = np.array_split(mine.trained().astype(np.float64) * n, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([n] * SLICES, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["slice", "part", "n", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["sums"].to_pylist(), strict=True))
        total = np.zeros(len(rows[0][2]) // 8)
        for *_, v in rows:
            total += np.frombuffer(v)
        return pa.table({"slice": table["slice"][:1], "n": pa.array([sum(r[1] for r in rows)], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = train.select("tokens" if cut else "text").mapInArrow(run, "slice int, part long, n long, sums binary")
    got = sorted(map(tuple, rows.groupBy("slice").applyInArrow(merge, "slice int, n long, sums binary").collect()))
    sent.destroy()
    if not got:
        return 0
    model.put(np.concatenate([np.frombuffer(v) for *_, v in got]) / got[0][1])
    return got[0][1]


def train_model(train: DataFrame, pieces: Pieces, counts: np.ndarray, id_col: str = "doc_id") -> Model:
    """The model after one pass over all windows of ``train``, in rounds."""
    model, share, low = Model(counts), F.pmod(F.xxhash64(id_col), F.lit(ROUNDS[-1])), 0
    for high, rate in zip(ROUNDS, RATES, strict=True):
        train_round(train.where((share >= low) & (share < high)), pieces, model, rate)
        low = high
    return model


def _row_ids() -> int:
    """The first row number of this task: rows are numbered by partition, whatever their ids."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    A null or empty text is one token, its end. Learns from the rows whose crc32(id) mod ``FOLDS``
    is not ``HELD_OUT``; rows without an id are scored but not learned from, and not held out.
    Repeated rows get equal scores. Without training rows the base is log10(1) and the model is
    uniform up to its starting weights. No rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 5000)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("held_out"))
    train = rows.where("not held_out")
    counts = Stage(count_words(train.select("text"), True), "words")
    ends = train.count()
    total, kinds = counts.df.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    words = frequent_words(counts.df, top, LONGEST)
    common = words if top == TOP else frequent_words(counts.df, TOP, LONGEST)  # pieces do not depend on what the base broadcasts
    merges = learn_merges(common, VOCABULARY - END - 1)
    pieces = Pieces({w: i for i, w in enumerate([bytes([i]) for i in range(END)] + merges)} if merges else read_ranks(vocabulary_path))
    start = pieces.choose(count_pieces(counts.df, pieces), ends)
    cut = Stage(cut_documents(rows, pieces, words, ends), "cut")
    texts = cut.df.where("n is null")
    model = train_model(texts.where("not held_out").select("doc_id", "tokens"), pieces, start)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        keep_memory()
        for batch in batches:
            tokens, n = text_bytes(batch.column(batch.num_columns - 1)), batch.num_columns - 1
            score = [_score_chunk(sent.value, tokens[a:b]) for a, b in chunks(tokens, TOGETHER)]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(np.concatenate([np.zeros(0), *score]))], names=[*batch.schema.names[:n], "score"])

    kind, base = dict(rows.dtypes)["doc_id"], ("row", "doc_id", "held_out", "n_tokens", "known", "logs")
    scored = Stage(texts.select(*base, "tokens").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double"), "scores")
    met = cut.df.where("n is not null").select("row", "word", "n").join(counts.df, "word")  # a word without a count adds log10(1)
    met = met.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = scored.df.join(met, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def ranks_of(pieces: Pieces) -> dict[bytes, int]:
    return {v: k for k, v in pieces.bytes.items()}


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _laid(pieces: Pieces, words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of words laid end to end, and how many each word has."""
    parts = [pieces.word(w) for w in words]
    width = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
    return np.fromiter(chain.from_iterable(parts), dtype=np.uint16, count=int(width.sum())), width


def _words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of texts end to end, A-Z lower-cased if so asked, and how many each text has."""
    texts = pc.fill_null(texts, "")
    rows = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, stop = rows.flatten(), rows.offsets.to_numpy()
    there = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty words
    return words.filter(pa.array(there)), np.diff(np.r_[0, np.cumsum(there)][stop])


def _numbered(texts: pa.Array, known: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that ``known`` lacks, each once, and where they stand; which words stand where (the others follow the known), and how many each text has."""
    words, size = _words(texts, True)
    ids = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().copy()
    rare = np.flatnonzero(ids < 0)
    other = words.take(pa.array(rare)).dictionary_encode()
    ids[rare] = other.indices.to_numpy() + len(known)
    return other.dictionary, rare, ids, size


def _pieces_of(laid: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the texts laid end to end, each with its end, and how many each text has."""
    flat, width = (np.concatenate(x) for x in zip(*laid, (np.array([END], dtype=np.uint16), np.ones(1, dtype=np.int32)), strict=True))
    first = np.cumsum(width, dtype=np.int32) - width
    stream = np.insert(ids, np.cumsum(size), len(width) - 1)  # an end after each text
    k = width[stream]
    at = np.repeat(first[stream] - (np.cumsum(k, dtype=np.int32) - k), k)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], np.add.reduceat(k, np.cumsum(size + 1) - size - 1).astype(np.int64) if len(size) else size


def tokens_of(pieces: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of texts laid end to end, each with its end, and how many each text has."""
    other, _, ids, size = _numbered(_strings(texts), _strings([]))
    tokens, lengths = _pieces_of([_laid(pieces, other.cast(pa.binary()).to_pylist())], ids, size)
    return tokens.astype(np.int64), lengths


def _cut_chunk(state: dict, texts: pa.Array) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, pa.Array, np.ndarray]]:
    """n_tokens, known and log10(count + 1) sums (frequent words and ends); the pieces and their numbers; and (text, word, n) of the other words."""
    other, rare, ids, size = _numbered(texts, state["words"])
    text, top, kinds = np.repeat(np.arange(len(size)), size), len(state["words"]), max(1, len(other))
    known = size - np.bincount(text[rare], minlength=len(size)) + (state["ends"] > 0)
    log = np.concatenate([state["logs"], np.zeros(len(other))])  # a word without a count adds 0
    logs = np.bincount(text, weights=log[ids], minlength=len(size)) + np.log10(state["ends"] + 1.0)
    pair, n = np.unique(text[rare] * kinds + (ids[rare] - top), return_counts=True)
    laid = [state["laid"], _laid(state["pieces"], other.cast(pa.binary()).to_pylist())]
    return [size + 1, known, logs], _pieces_of(laid, ids, size), (pair // kinds, other.take(pa.array(pair % kinds)), n.astype(np.int64))


def _score_chunk(model: Model, cut: list[bytes]) -> np.ndarray:
    """The log10 probability of each written text."""
    tokens, lengths = read_tokens(cut)
    return np.add.reduceat(model.score(tokens, lengths), np.cumsum(lengths) - lengths)
