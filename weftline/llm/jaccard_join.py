"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, triangle-inequality windows.

Sets of word shingles with 100 * |A n B| >= 80 * |A u B| link. Jaccard distance and the size of a
symmetric difference D are metrics, and links mean D(A, B) <= min(|A|, |B|) / 4. Equal sets are
one node from the start (the pivot at distance zero). Then

1. Rings about the empty set (its distance to A is |A|) bound the sizes; each node also enters the
   ring below when the triangle inequality lets it link there.
2. In a ring the shingles are dealt by hash into m > max D cells. A link's D must be 0 in more
   cells than it can touch, so the projections of both sets onto some cell are equal: every
   distinct projection is a pivot whose region's window is 0 wide, and nodes go to their regions
   as 8-byte keys.
3. Inside such a region a coarser metric bounds D from below: the Hamming distance of parity
   bitmaps of the sets. Pairs that it leaves connect nodes into candidate regions (components), so
   that each text is sent to one region only; regions of more than ``GROUP`` nodes connect as they
   are. A candidate region too large for a task is cut by rings about a pivot, with windows as
   wide as the largest linked distance, into pairs of blocks.
4. A region is joined exactly in memory: a pivot meets every node, those within its ball are
   linked with it, and the rest recurs with a pivot of its own. Pairs from two balls that are not
   yet connected are compared only inside the window that the triangle inequality leaves.

No link is lost or cut; what is not emitted are links inside a component that is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Stage, chunks, connected_components, mix64, release, small_batches, text_bytes

SHINGLE, PERCENT = 5, 80
#: Nodes (or shingles) of a region that one task joins; larger regions are cut into blocks of so many.
REGION_NODES, REGION_SHINGLES = 6000, 6_000_000
#: Nodes under one key that are compared by bitmaps before they connect; more connect at once.
GROUP = 4096
#: Nodes of one block of texts that a key is sent for, at most.
LOCAL = 64
#: Bytes of the bitmap of candidate ids that is broadcast, at most; beyond what it can tell apart more texts are shuffled, and none is lost.
FILTER_BYTES = 32 << 20
#: Ratio of a ring's bounds.
RING = 1.4
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class _Words(dict):
    """Signed 64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        found = self[word] = h - (h >> 63 << 64)
        return found


_words = _Words()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words, all words if fewer, none without words."""
    rows = [t.lower().split() for t in texts]
    sizes = list(map(len, rows))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=sum(sizes)).view(np.uint64)
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        s += h[k : n + k] * _FACTORS[k]
    s, at, out = mix64(s), 0, []
    for words, k in zip(rows, sizes, strict=True):
        if k > SHINGLE:
            x = np.sort(s[at : at + k - SHINGLE + 1])
            new = x[1:] != x[:-1]
            out.append(x if new.all() else x[np.r_[True, new]])
        elif k == SHINGLE:
            out.append(s[at : at + 1].copy())
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=k)] if k else [], dtype=np.uint64))
        at += k
    return out


def set_name(s: np.ndarray) -> bytes:
    """A 128-bit name of a set; equal sets have equal names."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _ring(n: int) -> int:
    return int(np.floor(np.log(max(n, 1)) / np.log(RING) + 1e-9))


@lru_cache(4096)
def _ring_low(k: int) -> int:
    """The least size in a ring."""
    n = max(1, int(np.floor(RING**k)) - 1)
    while _ring(n) < k:
        n += 1
    return n


@lru_cache(4096)
def _cells(k: int) -> tuple[int, int]:
    """The largest difference of a link in a ring, and its cells: more than that, and some to spare for empty ones."""
    most = (_ring_low(k + 1) - 1) * (100 - PERCENT) // PERCENT
    return most, most + 1 + most // 6


def region_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the regions that sets enter, and which set each is of: for its ring, and for rings below that a link can reach.

    With ``most`` the largest difference of a link and m cells, at least m - most cells agree. If
    fewer of a set's cells are empty than that, a link shares a cell that is not empty; otherwise
    the set also enters its empty cells, as does any partner that has as many (one that has fewer
    shares a cell with it that is not empty).
    """
    entry = [(i, k, *_cells(k)) for i, s in enumerate(sets) if len(s) for k in range(_ring(-(-PERCENT * len(s) // 100)), _ring(len(s)) + 1)]
    if not entry:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    who, ring, most, m = np.array(entry, dtype=np.int64).T
    size = np.array([len(sets[i]) for i in who.tolist()], dtype=np.int64)
    flat = np.concatenate([sets[i] for i in who.tolist()])
    base = np.cumsum(m) - m
    cell = (flat % np.repeat(m, size).astype(np.uint64)).astype(np.int64) + np.repeat(base, size)
    x, total = mix64(flat), int(m.sum())
    half = np.uint64(0xFFFFFFFF)
    low = np.bincount(cell, weights=(x & half).astype(np.float64), minlength=total)  # sums of 32-bit halves are exact in doubles
    high = np.bincount(cell, weights=(x >> np.uint64(32)).astype(np.float64), minlength=total)
    full = np.bincount(cell, minlength=total) > 0
    place = np.arange(total) - np.repeat(base, m)
    label = (np.repeat(ring + 1, m) << 40) + place
    key = mix64(low.astype(np.uint64) * _FACTORS[0] + high.astype(np.uint64) * _FACTORS[1] + mix64(label.astype(np.uint64)))
    empty = m - np.add.reduceat(full.astype(np.int64), base)
    take = full | np.repeat(empty >= m - most, m)
    return key[take], np.repeat(who, m)[take]


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of parities, of at least |s| bits (a power of two): two sets' bitmaps differ in no more places than the sets."""
    size = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix64(s + _FACTORS[2]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def near_pairs(ids: list[int], sizes: list[int], bits: list[bytes]) -> list[tuple[int, int]]:
    """Edges that connect the nodes of a group wherever sizes and bitmaps allow a link: D <= (|A| + |B|) / 9."""
    n = np.array(sizes, dtype=np.int64)
    maps = [np.frombuffer(b, dtype=np.uint64) for b in bits]
    words = min(map(len, maps))
    rows = np.stack([_fold(m, words) for m in maps])
    links = Links(len(ids))
    for i in range(len(ids) - 1):
        rest = np.bitwise_count(rows[i + 1 :] ^ rows[i]).sum(1, dtype=np.int64)
        ok = ((100 + PERCENT) * rest <= (100 - PERCENT) * (n[i + 1 :] + n[i])) & (100 * np.minimum(n[i + 1 :], n[i]) >= PERCENT * np.maximum(n[i + 1 :], n[i]))
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            links.join(i, j)
    return [(ids[k], ids[r]) for k in range(len(ids)) if (r := links.root(k)) != k and ids[k] != ids[r]]


def _combine(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Map-side combine: (keys, nodes) to send, and pairs (head, member) that connect at once.

    A key that more than ``LOCAL`` nodes of this block share is sent with its least node alone, and
    the others connect with that one; so no key, however common, leaves a block more than that
    often, and each pair leaves it once, however many keys it shares.
    """
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[first, len(keys)])
    many = np.repeat(size > LOCAL, size)
    lead = np.zeros(len(keys), dtype=bool)
    lead[first] = True
    head = np.repeat(sets[first], size)
    pair = np.unique(np.stack([head[many & ~lead], sets[many & ~lead]], axis=1), axis=0)
    return keys[~many | lead], sets[~many | lead], pair[:, 0], pair[:, 1]


class Links:
    """Union-find over nodes 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def join_region(sets: list[np.ndarray], links: Links | None = None) -> Links:
    """Connects all nodes of a region that links connect, exactly; ``links`` may hold what is known."""
    n = len(sets)
    links = links or Links(n)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= PERCENT * (size.sum() - both) and both:
            links.join(0, 1)
        return links
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, first = np.unique(flat, return_index=True)
    last = np.r_[first[1:], len(flat)]

    def shared(i: int) -> np.ndarray:
        """|A n B| of node i and every node, by its shingles' postings."""
        at = np.searchsorted(names, sets[i])
        a, k = first[at], last[at] - first[at]
        take = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return np.bincount(owner[take], minlength=n)

    def meet(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of node i to all, and which it links with."""
        both = shared(i)
        union = size + size[i] - both
        return 1 - both / np.maximum(union, 1), (100 * both >= PERCENT * union) & (both > 0)

    # cells: each pivot's ball, and every node's distance to the pivot
    free, pivots, far, ball = np.ones(n, dtype=bool), [], [], []
    for i in np.argsort(-size, kind="stable").tolist():
        if not free[i] or not size[i]:
            continue
        d, near = meet(i)
        for j in np.flatnonzero(near).tolist():
            links.join(i, j)
        ball.append(np.flatnonzero(free & near))
        free[near] = False
        free[i] = False
        if len(ball[-1]) > 1:
            pivots.append(i), far.append(d.astype(np.float32))
        else:
            ball.pop()
    # Pivots without a free neighbour are done: they have met every node. Two nodes that link and are no pivots lie in two balls.
    r, slack = 1 - PERCENT / 100, 1e-4
    for b, q in enumerate(pivots):
        for a in range(b):
            p = pivots[a]
            if links.root(p) == links.root(q) or far[a][q] > 3 * r + slack:
                continue
            x = ball[a][far[b][ball[a]] <= 2 * r + slack]
            y = ball[b][far[a][ball[b]] <= 2 * r + slack]
            if not len(x) or not len(y):
                continue
            if len(x) > len(y):
                x, y = y, x
            for i in x.tolist():
                if links.root(p) == links.root(q):
                    break
                window = y[(np.abs(far[a][y] - far[a][i]) <= r + slack) & (np.abs(far[b][y] - far[b][i]) <= r + slack)]
                if len(window):
                    near = meet(i)[1]
                    for j in window[near[window]].tolist():
                        links.join(i, j)
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Runs of rows (region, id, text) with the same region, from partitions sorted by region."""
    now, ids, texts = None, [], []
    for batch in batches:
        for region, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            if region != now:
                if ids:
                    yield now, ids, texts
                now, ids, texts = region, [], []
            ids.append(i), texts.append(t)
    if ids:
        yield now, ids, texts


def _distinct(ids: list[int], texts: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
    """One node for each distinct set; its id is the least."""
    nodes: dict[bytes, tuple[int, np.ndarray]] = {}
    for a, b in chunks(texts):
        for i, s in zip(ids[a:b], shingle_sets(texts[a:b]), strict=True):
            if len(s) and ((name := set_name(s)) not in nodes or i < nodes[name][0]):
                nodes[name] = (i, s)
    rows = sorted(nodes.values(), key=lambda r: r[0])
    return [i for i, _ in rows], [s for _, s in rows]


def _join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) that span the components of each region in sorted partitions."""
    src, dst = [], []
    for _, ids, texts in _groups(batches):
        ids, sets = _distinct(ids, texts)
        if len(ids) > 1:
            links = join_region(sets)
            for k in range(len(ids)):
                if (r := links.root(k)) != k:
                    src.append(ids[k]), dst.append(ids[r])
        if len(src) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
            src, dst = [], []
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _blocks(big: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """Pairs of blocks (_block, id, text) of regions too large for a task: rings about a pivot, windows one ring wide.

    The pivot is the least hashed node. Two linked nodes differ by at most 1 - PERCENT / 100 in
    their distance to it, so they lie in the same ring or in neighbouring ones of that width.
    """
    pivot = big.groupBy("region").agg(F.min_by(F.col("text"), F.struct(F.xxhash64("id"), "id")).alias("_pivot"), F.count("*").alias("_n"), F.sum("n").alias("_s"))
    parts = F.ceil(F.greatest(F.col("_n") / (nodes / 2), F.col("_s") / (shingles / 2))).cast("int")

    def ring(batches):
        for batch in batches:
            own = text_bytes(batch.column(batch.schema.get_field_index("text")))
            pivots = text_bytes(batch.column(batch.schema.get_field_index("_pivot")))
            rings, seen = [], {}
            for t, p in zip(own, pivots, strict=True):
                if p not in seen:
                    seen = {p: shingle_sets([p])[0]}
                s, q = shingle_sets([t])[0], seen[p]
                both = len(np.intersect1d(s, q, assume_unique=True))
                rings.append(int((1 - both / max(1, len(s) + len(q) - both)) / (1 - PERCENT / 100 + 1e-9)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("region", "id", "text", "_parts")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rings, pa.int32())], names=["region", "id", "text", "_parts", "_ring"])

    dealt = big.join(pivot.withColumn("_parts", parts).drop("_n", "_s"), "region").select("region", "id", "text", "_parts", "_pivot").mapInArrow(ring, "region long, id long, text string, _parts int, _ring int")
    # Block (ring, part) meets (ring, any later part) and (next ring, any part): at most 2 * parts + 1 copies of a node.
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_parts")).cast("int"))
    pair = lambda r, a, q, b: F.struct(r.alias("r"), a.alias("a"), q.alias("q"), b.alias("b"))
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    same = F.transform(every, lambda k: pair(F.col("_ring"), F.least(F.col("_part"), k), F.col("_ring"), F.greatest(F.col("_part"), k)))
    above = F.transform(every, lambda k: pair(F.col("_ring"), F.col("_part"), F.col("_ring") + 1, k))
    below = F.transform(every, lambda k: pair(F.col("_ring") - 1, k, F.col("_ring"), F.col("_part")))
    return dealt.withColumn("_pair", F.explode(F.concat(same, above, below))).select(F.xxhash64("region", "_pair").alias("region"), "id", "text")


def _filter_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(ids.view(np.uint64) + f) & np.uint64(bits - 1)).astype(np.int64) for f in _FACTORS[:2]]


def id_filter(ids: DataFrame, count: int, most_bytes: int = FILTER_BYTES):
    """A condition that all of the given longs meet and few others do, and what it broadcasts.

    A bitmap with two places for each id, added up by segments in tasks; its size follows the count
    up to ``most_bytes``. Only the id column goes to Python, texts stay where they are.
    """
    bits = 1 << min(max(13, (16 * max(1, count) - 1).bit_length()), (8 * most_bytes).bit_length() - 1)
    each = min(bits, 1 << 20) // 8  # bytes of a segment

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for places in _filter_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                segment = places // (8 * each)
                for k in np.unique(segment).tolist():
                    map_ = held.setdefault(k, np.zeros(8 * each, dtype=bool))
                    map_[places[segment == k] % (8 * each)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["segment", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(each, dtype=np.uint8)
        for v in table["bits"]:
            out |= np.frombuffer(v.as_py(), dtype=np.uint8)
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    rows = ids.mapInArrow(fill, "segment int, bits binary").groupBy("segment").applyInArrow(either, "segment int, bits binary").collect()
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for segment, v in rows:
        whole[segment * each : (segment + 1) * each] = np.frombuffer(v, dtype=np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:  # without nulls, which would turn longs into doubles
        found = np.ones(len(x), dtype=bool)
        for places in _filter_places(x.to_numpy().astype(np.int64), 8 * len(sent.value)):
            found &= (sent.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    return maybe, sent


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region_nodes: int = REGION_NODES, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the least id reachable by links.

    Null and empty texts have no shingles, are linked with nothing and are their own component. A
    row with a null id links with nothing and has no component (number rows first to link them, as
    the pipeline does). Repeated rows and equal texts are one node. No rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def deal(batches):
        """A row (id, n, name, short, bits) for each text, under a key of its own, and rows (key, short) for the regions of each new set."""
        seen: set[bytes] = set()  # sets this task has sent; bounded, a repeat only costs rows
        for batch in batches:
            texts, every = text_bytes(batch.column(1)), batch.column(0).to_pylist()
            for a, b in chunks(texts, 4_000_000):
                ids, sets, fresh, new = every[a:b], shingle_sets(texts[a:b]), [], []
                name = [set_name(s) if len(s) else None for s in sets]
                for i, s, x in zip(ids, sets, name, strict=True):
                    if i is not None and x is not None and x not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(x), fresh.append(s), new.append(int.from_bytes(x[:8], "little"))
                k, who = region_keys(fresh)
                k, x, head, tied = _combine(k, np.array(new, dtype=np.uint64)[who])
                own = mix64(mix64(head) + tied * _FACTORS[1])
                short = [int.from_bytes(v[:8], "little", signed=True) if v else None for v in name]
                spread = mix64(np.array([(v or 0) & 0xFFFFFFFFFFFFFFFF for v in ids], dtype=np.uint64)).view(np.int64)
                signed = lambda v: pa.array(v.view(np.int64))
                more = len(k) + len(own)
                cols = [pa.concat_arrays(c) for c in (
                    (signed(k), signed(own), pa.array(spread)), (signed(x), signed(tied), pa.array(short, pa.int64())),
                    (pa.nulls(len(k), pa.int64()), signed(head), pa.array(ids, pa.int64())), (pa.nulls(more, pa.int64()), pa.array([len(s) for s in sets], pa.int64())),
                    (pa.nulls(more, pa.binary()), pa.array(name, pa.binary())), (pa.nulls(more, pa.binary()), pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary())),
                )]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "short", "id", "n", "name", "bits"])

    def groups(batches):
        """Passes texts' rows on; of rows sorted by key, the distinct groups of two nodes or more, as rows (group, member).

        A group larger than ``GROUP`` streams by as rows (head, member) instead.
        """
        sent: set[int] = set()  # groups this task has sent; bounded, a repeat only costs rows
        key, tail, head = None, np.zeros(0, dtype=np.int64), None  # the last key and its nodes so far, or its head if they are many
        for batch in chain(batches, [None]):
            if batch is None:
                k = s = np.zeros(0, dtype=np.int64)
            else:
                mine, tied = batch.column(3).is_valid(), batch.column(2).is_valid()
                sets, pairs = batch.filter(mine), batch.filter(pc.and_(tied, pc.invert(mine)))
                rest = batch.filter(pc.invert(pc.or_(tied, mine)))
                if pairs.num_rows:
                    yield _row(pairs.num_rows, head=pairs.column(2), member=pairs.column(1))
                if sets.num_rows:
                    yield _row(sets.num_rows, id=sets.column(2), n=sets.column(3), name=sets.column(4), short=sets.column(1), bits=sets.column(5))
                if not rest.num_rows:
                    continue
                k, s = rest.column(0).to_numpy(), rest.column(1).to_numpy()
            if head is not None and len(k) and k[0] == key:  # go on with a large group
                m = int(np.searchsorted(k != key, True)) if k[-1] != key else len(k)
                many = np.unique(s[:m][s[:m] != head])
                yield _row(len(many), head=np.full(len(many), head), member=many)
                k, s = k[m:], s[m:]
                if not len(k):
                    continue
            head = None
            k, s = np.concatenate([np.full(len(tail), key if key is not None else 0, dtype=np.int64), k]), np.concatenate([tail, s])
            if not len(k):
                continue
            new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
            k, s = k[new], s[new]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            end = np.r_[first[1:], len(k)]
            if batch is not None:  # the last group may go on
                key, tail = k[-1], s[first[-1] :]
                first, end = first[:-1], end[:-1]
                if len(tail) > GROUP:
                    head, many, tail = tail[0], tail[1:], tail[:0]
                    yield _row(len(many), head=np.full(len(many), head), member=many)
            two = first[end - first == 2]
            name = mix64(mix64(s[two].view(np.uint64)) + s[two + 1].view(np.uint64) * _FACTORS[3]).view(np.int64)
            name, at = np.unique(name, return_index=True)
            group, member = [name, name], [s[two][at], s[two + 1][at]]
            for a, b in zip(first.tolist(), end.tolist(), strict=True):
                if b - a > 2:
                    x = xxhash.xxh3_64_intdigest(s[a:b].tobytes())
                    if x not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(x)
                        group.append(np.full(b - a, x - (x >> 63 << 64), dtype=np.int64)), member.append(s[a:b])
            group, member = np.concatenate(group), np.concatenate(member)
            yield _row(len(group), group=group, member=member)

    def near(batches):
        """Of rows sorted by group, the edges that bitmaps leave."""
        now, ids, sizes, bits, src, dst = None, [], [], [], [], []
        for batch in batches:
            for g, i, n, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if g != now:
                    edges = near_pairs(ids, sizes, bits) if len(ids) > 1 else []
                    src += [x for x, _ in edges]
                    dst += [y for _, y in edges]
                    now, ids, sizes, bits = g, [], [], []
                ids.append(i), sizes.append(n), bits.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
            src, dst = [], []
        edges = near_pairs(ids, sizes, bits) if len(ids) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["src", "dst"])

    dealt = rows.mapInArrow(deal, "key long, short long, id long, n long, name binary, bits binary").repartition(_partitions(spark), "key").sortWithinPartitions("key", "short")
    both = Stage(dealt.mapInArrow(groups, ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())), "sets")
    del dealt
    release(spark)
    sets = both.df.where("n is not null").select("id", "n", "name", "short")
    marks = both.df.where("n > 0").groupBy("name").agg(F.first("short").alias("short"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    members = both.df.where("`group` is not null").select("group", "member").distinct().join(marks, F.col("member") == F.col("short")).select("group", "member", "n", "bits")
    pairs = members.repartition(_partitions(spark), "group").sortWithinPartitions("group").mapInArrow(near, "src long, dst long")
    pairs = Stage(pairs.unionByName(both.df.where("head is not null").select(F.col("head").alias("src"), F.col("member").alias("dst"))).distinct(), "pairs")
    regions = connected_components(pairs.df)
    pairs.drop()

    # one document stands for each set; sets whose region holds another are sent there with their text
    one = sets.where("name is not null and id is not null").groupBy("name", "short").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    nodes = Stage(one.join(regions.df, F.col("short") == F.col("node")).select(F.col("id").alias("node_id"), "n", F.col("component").alias("region")), "nodes")
    regions.drop()
    sizes = nodes.df.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    big = sizes.where((F.col("k") > region_nodes) | (F.col("s") > region_shingles)).select("region")
    maybe, sent = id_filter(nodes.df.select("node_id"), nodes.df.count())
    texts = rows.where(maybe(F.coalesce("id", F.lit(0)))).join(nodes.df, F.col("id") == F.col("node_id")).select("region", "id", "text", "n")
    edges = texts.join(big, "region", "left_anti").select("region", "id", "text").repartition(_partitions(spark), "region").sortWithinPartitions("region").mapInArrow(_join_rows, "src long, dst long")
    if big.limit(1).count():
        cut = _blocks(texts.join(big, "region", "left_semi"), region_nodes, region_shingles)
        edges = edges.unionByName(cut.repartition(_partitions(spark), "region").sortWithinPartitions("region").mapInArrow(_join_rows, "src long, dst long"))
    found = Stage(edges, "links")
    joined = connected_components(found.df)
    found.drop(), nodes.drop(), sent.destroy()
    least = sets.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("least"))
    least = least.join(joined.df, F.col("least") == F.col("node"), "left").select("name", F.coalesce("component", "least").alias("component"))
    least = Stage(least, "least").df  # so that a hot set's rows, not its aggregate, are dealt and can be split
    joined.drop()
    return sets.join(least, "name", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


_COLUMNS = {"group": "long", "member": "long", "head": "long", "id": "long", "n": "long", "name": "binary", "short": "long", "bits": "binary"}


def _row(length: int, /, **given) -> pa.RecordBatch:
    """A batch of so many rows with the given columns, null elsewhere."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], kinds[v]) if k in given else pa.nulls(length, kinds[v]) for k, v in _COLUMNS.items()], names=list(_COLUMNS))


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
