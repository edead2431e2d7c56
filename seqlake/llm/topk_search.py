"""Exact top-k search by inner product with KD-trees, one per shard.

Each shard of the candidates gets a KD-tree: median splits of the widest dimension, tight
bounding boxes at every node. A query walks the tree best first: the node whose box allows the
highest product comes next, and the walk ends when no box left can reach the query's k-th
score. Queries search the shard that their own id falls into first; the k-th score found there
is carried along to all other shards, so most of their boxes are cut off at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import stored
from seqlake.llm.vectors import matrix, usable

SHARD = 8192          # candidates per tree
MIN_SHARDS = 12       # so that small tables keep all executors busy too
LEAF = 256            # candidates per leaf
MOST = 2.0 ** 500     # components beyond it count as it: their products exceed a long anyhow
QUERY_BLOCK = 4096    # queries that one task answers over one tree


class KDTree:
    """Median-split tree over the rows of ``x``; ``low``/``high`` bound each node tightly."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = x[self.order[start:end]]
            low.append(own.min(0))
            high.append(own.max(0))
            node = len(self.span)
            self.span.append((start, end))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            axis = int(np.argmax(high[-1] - low[-1]))
            if end - start > LEAF and high[-1][axis] > low[-1][axis]:
                half = (end - start) // 2
                cut = np.argpartition(own[:, axis], half)
                self.order[start:end] = self.order[start:end][cut]
                todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.x = x[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product that a point in each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


EXACT = float(1 << 53)      # products up to which doubles hold every integer
LONG = (1 << 63) - 1


def _whole_scores(x: np.ndarray, q: list[int]) -> np.ndarray:
    """Inner products by integers of any size, kept in the range of a long."""
    scores = (sum(int(a) * b for a, b in zip(row, q)) for row in x.tolist())
    return np.array([max(-LONG, min(LONG, s)) for s in scores], dtype=np.int64)


def search(tree: KDTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
           floor: np.ndarray) -> list[tuple[int, int, int]]:
    """``(query_id, vec_id, score)`` of each query's ``k`` best candidates of the tree that can
    be among its ``k`` best overall: ``floor`` is a score its k-th best is known to reach.

    Where products can leave the integers that doubles hold, scores are taken from integers and
    the bounds get room for their rounding, so that nothing is cut off too early."""
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    far = np.abs(queries).sum(1) * max(np.abs(tree.low).max(), np.abs(tree.high).max())
    out = []
    for qi, q in enumerate(queries):
        large = far[qi] >= EXACT
        least, bound = float(floor[qi]), bounds[qi]
        if large:
            room, whole = far[qi] * 1e-9, [int(v) for v in q.tolist()]
            least, bound = max(least, -float(LONG)) - room if np.isfinite(least) else -np.inf, bound + room
        best_score, best_id = np.empty(0, dtype=np.int64 if large else np.float64), np.empty(0, dtype=np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < least:          # an equal score may still win by a smaller id
                break
            pair = tree.children[node]
            if pair is not None:
                for c in pair:
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            start, end = tree.span[node]
            score = _whole_scores(tree.x[start:end], whole) if large else tree.x[start:end] @ q
            hit = np.flatnonzero((score >= least) & (ids[start:end] != query_ids[qi]))
            if len(hit):
                best_score = np.concatenate((best_score, score[hit]))
                best_id = np.concatenate((best_id, ids[start:end][hit]))
                top = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[top], best_id[top]
                if len(top) == k:
                    last = float(best_score[-1])
                    least = max(least, last - room if large else last)
        out += [(int(query_ids[qi]), int(i), int(s)) for i, s in zip(best_id, best_score)]
    return out


def _search_group(table: pa.Table, k: int) -> pa.Table:
    d = table["dim"][0].as_py()
    asks = table["ask"].to_numpy(zero_copy_only=False)
    rows, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    found: list[tuple[int, int, int]] = []
    if rows.num_rows and queries.num_rows:
        tree = KDTree(matrix(rows["vec"].combine_chunks(), d))
        floor = queries["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
        found = search(tree, rows["vec_id"].to_numpy(), matrix(queries["vec"].combine_chunks(), d),
                       queries["vec_id"].to_numpy(), k, np.where(np.isnan(floor), -np.inf, floor))
    return pa.table({n: pa.array([f[i] for f in found], pa.int64())
                     for i, n in enumerate(("query_id", "vec_id", "score"))})


def _quantized(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.clip(np.floor(scale * np.clip(np.frombuffer(v), -MOST, MOST)), -MOST, MOST).tobytes()
                for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())],
                                         names=["vec_id", "dim", "vec"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector for which ``is_query`` (a condition
    on the column ``vec_id``) holds, the ``k`` other vectors with the highest inner product of
    components ``floor(scale * x)``; ties go to the smaller id. Fewer rows if there are fewer.

    Defined cases: null and empty vectors, vectors with null or non-finite components and
    vectors without an id take no part. A query is compared with vectors of its own length
    and with ids other than its own. Of several rows with a query's id, all are candidates;
    the one with the smallest components in byte order asks. Scores are exact while products
    and sums stay below 2**53 in size. Other columns are not read.
    """
    points = stored(usable(vectors, id_col, vec_col).filter("vec_id IS NOT NULL").mapInArrow(
        lambda it: _quantized(it, scale), "vec_id bigint, dim int, vec binary"), "points")
    n = points.count()
    shards = max(MIN_SHARDS, -(-n // SHARD))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    rows = points.withColumn("shard", shard)
    asks = points.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("q")) \
                 .select("vec_id", "q.dim", "q.vec", shard.alias("home"))
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.lit(None).cast("double")

    def found(queries: DataFrame, at: str) -> DataFrame:
        both = rows.select("dim", "shard", every.alias("block"), "vec_id", "vec",
                           F.lit(False).alias("ask"), none.alias("floor")).unionAll(
            queries.select("dim", F.col(at).alias("shard"), block.alias("block"), "vec_id", "vec",
                           F.lit(True).alias("ask"), "floor"))
        return both.groupBy("dim", "shard", "block").applyInArrow(
            lambda t: _search_group(t, k), "query_id bigint, vec_id bigint, score bigint")

    home = stored(found(asks.withColumn("floor", none), "home"), "home")
    floor = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")) \
                .select(F.col("query_id").alias("vec_id"),
                        F.when(F.col("n") == k, F.col("low")).cast("double").alias("floor"))
    away = asks.join(floor, "vec_id", "left") \
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) \
               .filter("shard <> home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionAll(found(away, "shard")).withColumn("rank", F.row_number().over(best)) \
               .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
