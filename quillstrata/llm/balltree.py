"""Exact top-k by inner product: a ball tree for each shard, searched best bound first.

Vectors become integers, floor(SCALE * x). They are dealt by a hash of their id into shards of at most about SHARD_ROWS
rows and SHARD_BYTES; each shard's tree is built once and stored as one row. A node is a ball; the inner product of a
query with anything in it is at most q.centre + |q| * radius. Nodes are visited in the order of their bounds; a node whose
bound is below the k-th score ends the search. Ties go to the smaller vec_id, so a node whose bound equals it is visited.

Queries are dealt into blocks of about BLOCK_ROWS and go to the trees: a stated query set against all rows, in blocks.
In the first round a block meets one shard, which gives each query a k-th score. It is shared with all other shards: in
the second round a block meets every shard with that score as the floor, so a tree whose root is below it is left at once
and only scores that reach it come back. A task reads a tree, then the blocks that meet it, one after another; trees that
many blocks meet are dealt to several tasks (BLOCKS_A_TASK).

Null vectors, and those that hold null or non-finite components, take no part; shorter vectors count as padded with
zeros. Scores are exact in whole numbers; those beyond the range of long, and components beyond it, count as its limit.
Repeated vec_ids are separate candidates and separate queries; a row with a query's own id is never its candidate. An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import cut

SCALE = 1024
QUERY_EVERY = 100
K = 10
#: Bounds of a shard: rows, and bytes of its vectors as 64-bit numbers.
SHARD_ROWS, SHARD_BYTES = 16_384, 32_000_000
BLOCK_ROWS = 256
#: Blocks that one task searches a tree for, one after another.
BLOCKS_A_TASK = 16
LEAF = 64
_LONG = np.iinfo(np.int64)


def _narrow(rows: np.ndarray) -> np.ndarray:
    """rows in the smallest integer type that holds them."""
    low, high = rows.min(initial=0), rows.max(initial=0)
    return rows.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class BallTree:
    """Rows in leaf order with, per node, first and last row, children (-1: a leaf), centre and radius."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.ids, self.rows, self.nodes, self.centres, self.radii = ids, rows, nodes, centres, radii

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> BallTree:
        order = np.argsort(ids, kind="stable")
        x, place = vectors[order].astype(np.float64), np.arange(len(ids))
        nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []

        def grow(a: int, b: int) -> int:
            own = x[place[a:b]]
            centre = own.mean(axis=0)
            gap = own - centre
            far = np.einsum("ij,ij->i", gap, gap)
            me = len(nodes)
            nodes.append((a, b, -1, -1))
            centres.append(centre)
            radii.append(float(np.sqrt(far.max())))
            if b - a > LEAF and radii[me] > 0:
                pole = gap[far.argmax()]
                side = own @ (pole - gap[((gap - pole) ** 2).sum(axis=1).argmax()])
                half = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(side, half)]
                left = grow(a, a + half)
                nodes[me] = (a, b, left, grow(a + half, b))
            return me

        if len(ids):
            grow(0, len(ids))
        return cls(ids[order][place], _narrow(vectors[order][place]), np.array(nodes, np.int32).reshape(-1, 4), np.array(centres).reshape(len(nodes), -1), np.array(radii))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, rows=self.rows, nodes=self.nodes, centres=self.centres, radii=self.radii)
        return out.getvalue()

    @classmethod
    def unpack(cls, body: bytes) -> BallTree:
        with np.load(io.BytesIO(body)) as z:
            return cls(z["ids"], z["rows"], z["nodes"], z["centres"], z["radii"])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query at most k (score, -vec_id), those of at least its floor."""
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        if not len(self.nodes):
            return best
        d = max(queries.shape[1], self.rows.shape[1])
        queries, rows, centres = _level(queries, d), _level(self.rows, d), _level(self.centres, d)
        # Exact in floating point, in 64-bit numbers, or else in Python's.
        most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * d
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        rows, own = rows.astype(kind), queries.astype(kind)
        asked = queries.astype(np.float64)
        length = np.sqrt((asked * asked).sum(axis=1))
        size = np.sqrt((centres * centres).sum(axis=1))
        # The last term covers what rounding may take from a bound.
        bounds = asked @ centres.T + length[:, None] * self.radii + (1e-9 * length[:, None] * (self.radii + size) + 1e-6)
        nodes, ids = self.nodes.tolist(), self.ids
        for i, heap in enumerate(best):
            bound, me, q, floor = bounds[i], query_ids[i], own[i], int(floors[i])
            todo = [(-bound[0], 0)]
            while todo:
                low, at = heapq.heappop(todo)
                least = heap[0][0] if len(heap) == k else floor
                if -low < least:
                    break
                a, b, left, right = nodes[at]
                if left >= 0:
                    heapq.heappush(todo, (-bound[left], left))
                    heapq.heappush(todo, (-bound[right], right))
                    continue
                scores = rows[a:b] @ q
                if kind is object:
                    scores = np.array([min(max(x, _LONG.min), _LONG.max) for x in scores], object)
                for j in np.flatnonzero(scores >= least).tolist():
                    if (v := int(ids[a + j])) != me:
                        item = (int(scores[j]), -v)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
        return best


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<long>): the rows that take part."""
    x = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return table.where(x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(SCALE * c.cast("double"))).alias("v")
    )


def _matrix(vectors: Sequence[Sequence[int]]) -> np.ndarray:
    m = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def _level(a: np.ndarray, d: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, d - a.shape[1])))


def _planted(table: pd.DataFrame) -> pd.DataFrame:
    """One shard's rows (shard, vec_id, v) as its tree."""
    return pd.DataFrame([{"shard": table["shard"].iloc[0], "body": BallTree.build(table["vec_id"].to_numpy(np.int64), _matrix(table["v"])).pack()}])


def _asked(table: pd.DataFrame) -> pd.DataFrame:
    """One block's queries (block, vec_id, v) as a row, without floors."""
    table = table.sort_values("vec_id", kind="stable")
    ids, m = table["vec_id"].to_numpy(np.int64), _matrix(table["v"])
    return pd.DataFrame([{"block": table["block"].iloc[0], "ids": ids.tobytes(), "body": m.tobytes(), "floors": np.full(len(ids), _LONG.min).tobytes()}])


def _meetings(trees: DataFrame, blocks: DataFrame, lanes: int, tasks: int) -> DataFrame:
    """trees (shard, body), blocks (shard, block, ids, body, floors): a shard's tree, then its blocks, in lanes of a task each."""
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    left = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).alias("block"), none("ids", "binary"), "body", none("floors", "binary"))
    right = blocks.select("shard", F.pmod("block", F.lit(lanes)).cast("int").alias("lane"), "block", "ids", "body", "floors")
    return left.union(right).repartition(tasks, "shard", "lane").sortWithinPartitions("shard", "lane", "block")


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, list[list[tuple[int, int]]]]]:
    """(row, query ids, queries, best) of each block among the rows of _meetings()."""
    tree, of = None, None
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in ("shard", "block", "ids", "body", "floors")}
            if row["block"] < 0:
                tree, of = BallTree.unpack(row["body"]), row["shard"]
                continue
            ids = np.frombuffer(row["ids"], np.int64)
            queries = np.frombuffer(row["body"], np.int64).reshape(len(ids), -1)
            # A shard without rows has no tree.
            yield row, ids, queries, tree.search(queries, ids, np.frombuffer(row["floors"], np.int64), k) if of == row["shard"] else [[] for _ in ids]


def top_inner_products(table: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; queries are the rows whose id query_every divides."""
    rows = cut(whole_vectors(table, id_col, vector_col))
    is_query = F.col("vec_id") % query_every == 0
    total, asked, width = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = total // max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, width)))) + 1
    blocks = asked // BLOCK_ROWS + 1
    lanes = (blocks - 1) // BLOCKS_A_TASK + 1
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    trees = cut(rows.withColumn("shard", dealt(shards, 1)).repartition(shards, "shard").groupBy("shard").applyInPandas(_planted, "shard int, body binary"))
    questions = rows.where(is_query).withColumn("block", dealt(blocks, 2)).groupBy("block").applyInPandas(_asked, "block int, ids binary, body binary, floors binary")
    # Asked for by number, so that adaptive execution does not put the few bytes of many trees in one task.
    tasks = min(shards * lanes, 10_000)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, best in _searched(batches, k):
            floors = np.array([min(heap)[0] if len(heap) == k else _LONG.min for heap in best], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (row["ids"], row["body"], floors.tobytes()))], ["block", "ids", "body", "floors"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, _, best in _searched(batches, k):
            out = [(row["block"] << 32 | i, q, -v, s) for i, (q, heap) in enumerate(zip(ids.tolist(), best, strict=True)) for s, v in heap]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["query", "query_id", "vec_id", "score"])

    if shards > 1:
        home = questions.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
        questions = _meetings(trees, home, 1, shards).mapInArrow(floored, "block int, ids binary, body binary, floors binary")
    everywhere = cut(questions).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    candidates = _meetings(trees, everywhere, lanes, tasks).mapInArrow(found, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
