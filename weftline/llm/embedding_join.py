"""Exact metric range join of embeddings under the angle, by pivots, cells and windows.

Vectors link when their cosine is at least ``LEAST``: when their angle, a metric, is at most
r = arccos(LEAST). Equal vectors are one node with a multiplicity. Every node lies in the cell of
its nearest pivot p, and is also sent to the cell of each pivot q with angle(x, q) <= angle(x, p) +
2 r: by the triangle inequality no node of another cell can link with one of that cell otherwise.
Cells join independently, in blocks of own nodes against all the cell holds, streamed; the larger the table,
the larger the blocks, as each vector is sent to every block of the cells that its window takes in.
The cosine is computed in single precision to find pairs near the bound and above, and decided in
double precision.

In many dimensions and without structure all angles are alike, the windows take in every cell, and
the join is one of every block with every node; that is the cost of an exact answer there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Stage, connected_components, small_batches

LEAST = 0.9
#: Own nodes of a block, at least and at most (a 64th of all between them); pivots at most.
BLOCK, LARGEST, PIVOTS = 4096, 65_536, 512


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in their own precision: not null, no null, finite, not zero."""
    out: list[np.ndarray | None] = []
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    for x in column:
        v = None if not x.is_valid else np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=kind)
        if v is not None and (not len(v) or x.values.null_count or not np.isfinite(v).all() or not np.linalg.norm(v.astype(np.float64)) > 0):
            v = None
        out.append(v)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    A null or zero vector, or one with null or non-finite components, links with nothing and is its
    own component; so are vectors of different lengths to each other. Equal vectors link. A row with a
    null id links with nothing, counts for no other row and has no component. Rows that repeat an id are
    vectors of their own. No rows give none; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    single = "float" in dict(rows.dtypes)["v"]
    kind = np.float32 if single else np.float64

    def read(batches):
        for batch in batches:
            vs = _vectors(batch.column(1))
            raw = [None if v is None or i is None else (v + kind(0)).tobytes() for v, i in zip(vs, batch.column(0).to_pylist(), strict=True)]  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array([0 if v is None else len(v) // kind(0).itemsize for v in raw], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "name", "dim", "raw"])

    read_rows = Stage(rows.mapInArrow(read, "vec_id long, name binary, dim int, raw binary"), "vectors")
    nodes = Stage(read_rows.df.where("name is not null").groupBy("name").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "nodes")
    total = nodes.df.count()
    block = min(max(block, total // 64), max(block, LARGEST))
    cells = int(np.clip(-(-total // block), 1, PIVOTS))
    sample = nodes.df.orderBy(F.xxhash64("name"), "name").limit(cells).select("dim", "raw").collect()  # PIVOTS bounds it
    pivots: dict[int, np.ndarray] = {}
    for dim in {r[0] for r in sample}:
        pivots[dim] = _unit(np.stack([np.frombuffer(r[1], dtype=kind) for r in sample if r[0] == dim]))
    window = 2 * np.arccos(least) + 1e-6

    def place(batches):
        """The own cell of each node and the cells whose window it lies in."""
        for batch in batches:
            dims = batch.column(2).to_pylist()
            raw = batch.column(3).to_pylist()
            own, also = [0] * len(raw), [[]] * len(raw)
            for dim in set(dims) & set(pivots):
                at = [i for i, d in enumerate(dims) if d == dim]
                angle = np.arccos(np.clip(_unit(np.stack([np.frombuffer(raw[i], dtype=kind) for i in at])) @ pivots[dim].T, -1, 1))
                near = angle.argmin(1)
                reach = angle <= (angle[np.arange(len(at)), near] + window)[:, None]
                for k, i in enumerate(at):
                    own[i], also[i] = int(near[k]), np.flatnonzero(reach[k]).tolist()
            also = [a or [0] for a in also]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(own, pa.int32()), pa.array(also, pa.list_(pa.int32()))], names=["id", "copies", "dim", "raw", "own", "also"])

    placed = Stage(nodes.df.select("id", "copies", "dim", "raw").mapInArrow(place, "id long, copies long, dim int, raw binary, own int, also array<int>"), "cells")
    sizes = placed.df.groupBy("dim", "own").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    counted = Stage(sizes.select(F.col("dim").alias("_dim"), F.col("own").alias("_cell"), "blocks"), "blocks")  # a row for each pivot and length; written, so that Spark sees that it is small
    blocks = counted.df
    homes = placed.df.join(blocks, (F.col("dim") == F.col("_dim")) & (F.col("own") == F.col("_cell")))
    homes = homes.select("dim", "own", F.pmod(F.xxhash64("id", "raw"), F.col("blocks")).cast("int").alias("part"), F.lit(0).alias("role"), "id", "copies", "raw")
    guests = placed.df.select("dim", "id", "copies", "raw", F.explode("also").alias("own")).join(blocks, (F.col("dim") == F.col("_dim")) & (F.col("own") == F.col("_cell")))
    guests = guests.select("dim", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("role"), "id", "copies", "raw")

    def join(batches):
        now, home_ids, home_raw, ready = None, [], [], None
        for batch in batches:
            dim, own, part, role, ids, copies, raw = (batch.column(c).to_pylist() for c in range(7))
            keys = list(zip(dim, own, part, strict=True))
            a = 0
            while a < len(keys):
                b = a
                while b < len(keys) and keys[b] == keys[a] and role[b] == role[a]:
                    b += 1
                if keys[a] != now:
                    if ready:
                        yield from ready.out()
                    now, home_ids, home_raw, ready = keys[a], [], [], None
                if role[a] == 0:
                    home_ids += ids[a:b]
                    home_raw += raw[a:b]
                elif home_ids:
                    ready = ready or _Block(home_ids, np.stack([np.frombuffer(r, dtype=kind) for r in home_raw]), least)
                    ready.meet(ids[a:b], np.array(copies[a:b]), np.stack([np.frombuffer(r, dtype=kind) for r in raw[a:b]]))
                a = b
        if ready:
            yield from ready.out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = homes.unionByName(guests).repartition(n, "dim", "own", "part").sortWithinPartitions("dim", "own", "part", "role")
    found = Stage(dealt.mapInArrow(join, "id long, links long, other long"), "neighbours")
    placed.drop(), counted.drop()
    joined = connected_components(found.df.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    counts = found.df.where("links is not null").groupBy(F.col("id").alias("_c")).agg(F.max("links").alias("links"))
    near = nodes.df.select("name", "id").join(counts, F.col("id") == F.col("_c"), "left").join(joined.df, F.col("id") == F.col("node"), "left")
    near = near.select("name", (F.col("links") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    near = Stage(near, "near").df  # so that a hot vector's rows, not its aggregate, are dealt and can be split
    for stage in (nodes, found, joined):
        stage.drop()
    out = read_rows.df.select("vec_id", "name").join(near, "name", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


class _Block:
    """Own nodes of one block: counts the links of each (copies included), and keeps edges that span components."""

    def __init__(self, ids: list[int], rows: np.ndarray, least: float):
        from weftline.llm.jaccard_join import Links

        self.ids, self.rows, self.least = ids, rows.astype(np.float64), least
        self.norm = np.linalg.norm(self.rows, axis=1)
        self.short = (self.rows / self.norm[:, None]).astype(np.float32)
        self.links = np.zeros(len(ids), dtype=np.int64)
        self.number: dict[int, int] = {}
        self.tree, self.edges = Links(0), []

    def _node(self, i: int) -> int:
        if i not in self.number:
            self.number[i] = len(self.tree.up)
            self.tree.up.append(self.number[i])
        return self.number[i]

    def meet(self, ids: list[int], copies: np.ndarray, rows: np.ndarray) -> None:
        rows = rows.astype(np.float64)
        norm = np.linalg.norm(rows, axis=1)
        short = (rows / norm[:, None]).astype(np.float32)
        for a in range(0, len(ids), 1024):
            h, m = np.nonzero(self.short @ short[a : a + 1024].T >= self.least - 1e-4)
            m += a
            for s in range(0, len(h), 50_000):
                i, j = h[s : s + 50_000], m[s : s + 50_000]
                ok = np.einsum("ij,ij->i", self.rows[i], rows[j]) / (self.norm[i] * norm[j]) >= self.least
                same = np.fromiter((self.ids[x] == ids[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)), dtype=bool, count=len(i))
                i, j = i[ok | same], j[ok | same]
                np.add.at(self.links, i, copies[j])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if self.ids[x] != ids[y] and self.tree.join(self._node(self.ids[x]), self._node(ids[y])):
                        self.edges.append((self.ids[x], ids[y]))

    def out(self):
        e = self.edges
        yield pa.RecordBatch.from_arrays([pa.array([*self.ids, *(x for x, _ in e)], pa.int64()), pa.array([*self.links.tolist(), *[None] * len(e)], pa.int64()), pa.array([*[None] * len(self.ids), *(y for _, y in e)], pa.int64())], names=["id", "links", "other"])
