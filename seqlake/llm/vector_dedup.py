"""Embedding near-duplicates: all pairs of vectors, compared in tiles along PCA order.

Vectors are scaled to length 1 and rotated onto the principal axes (largest variance first).
The vectors are dealt into blocks; one task compares two blocks tile by tile. Of each tile the
products of the ``LEAD`` leading dimensions come first; to them the product of the remaining
norms is added (Cauchy-Schwarz). Pairs whose bound stays below the threshold are out, and a
tile without pairs left stops there; the others go on with the next dimensions. What remains
is decided by the cosine of the vectors as given, in double precision.

A task returns sums, not pairs: the number of links of each vector, and one edge per linked
vector that joins it with its component among the two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import components, stored
from seqlake.llm.vectors import matrix, unit, usable

BLOCK = 8192       # vectors per block: a task holds two blocks
MIN_BLOCKS = 12    # so that small tables keep all executors busy too
TILE = 512
LEAD = 16          # dimensions of the first pass
NEAR = 1e-9        # distance from the threshold within which the given vectors decide


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension: number, sum and second moments of the unit vectors of a partition."""
    acc: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims).tolist():
            x, _ = unit(matrix(batch.column(1).filter(pa.array(dims == d)), d))
            m = np.vstack((np.append(x.sum(0), len(x)), np.column_stack((x.T @ x, np.zeros(d)))))
            acc[d] = acc[d] + m if d in acc else m
    if acc:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(acc), pa.int32()),
             pa.array([m.tobytes() for m in acc.values()], pa.binary())], names=["dim", "vec"])


def _add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            m = np.frombuffer(data)
            acc[d] = acc[d] + m if d in acc else m
    if acc:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(acc), pa.int32()),
             pa.array([m.tobytes() for m in acc.values()], pa.binary())], names=["dim", "vec"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, largest variance first) per dimension, over all vectors. The
    driver gets one matrix per dimension and adder."""
    parts = classes.select("dim", "vec").mapInArrow(_moments, "dim int, vec binary")
    parts = parts.repartition(8).mapInArrow(_add_moments, "dim int, vec binary")
    total: dict[int, np.ndarray] = {}
    for row in parts.collect():
        m = np.frombuffer(row["vec"]).reshape(row["dim"] + 1, row["dim"] + 1)
        total[row["dim"]] = total.get(row["dim"], 0) + m
    axes = {}
    for d, m in total.items():
        n, mean = m[0, d], m[0, :d] / m[0, d]
        _, v = np.linalg.eigh(m[1:, :d] / n - np.outer(mean, mean))
        axes[d] = np.ascontiguousarray(v[:, ::-1])
    return axes


def _tile(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, lead: int,
          least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile that can reach ``least`` and their cosines in rotated coordinates.
    ``rest_*[:, k]`` is the norm of the dimensions from ``k * lead`` on."""
    d = a.shape[1]
    bound = np.column_stack((a[:, :lead], rest_a[:, 1])) @ np.column_stack((b[:, :lead], rest_b[:, 1])).T
    i, j = np.nonzero(bound >= least)
    if not len(i):
        return i, j, bound[:0, 0]
    if len(i) > bound.size // 16:                    # a tile of copies: whole products are cheaper
        whole = a @ b.T
        i, j = np.nonzero(whole >= least)
        return i, j, whole[i, j]
    part = bound[i, j] - rest_a[i, 1] * rest_b[j, 1]
    for k, at in enumerate(range(lead, d, lead), start=1):
        part = part + np.einsum("ij,ij->i", a[i, at:at + lead], b[j, at:at + lead])
        alive = part + rest_a[i, k + 1] * rest_b[j, k + 1] >= least
        i, j, part = i[alive], j[alive], part[alive]
        if not len(i):
            break
    return i, j, part


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the components of ``i`` and ``j``; ``parent`` holds the root of every vertex."""
    differ = parent[i] != parent[j]
    if not differ.any():
        return parent
    pairs = np.unique(np.stack((parent[i[differ]], parent[j[differ]]), axis=1), axis=0)
    parent = parent.copy()

    def root(x: int) -> int:
        while parent[x] != x:
            x = int(parent[x])
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _compare(table: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """Two blocks (or one with itself): links per vector and an edge to its component's root."""
    d = table["dim"][0].as_py()
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    block = table["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    table = table.take(pa.array(order))
    cls, copies = table["cls"].to_numpy(), table["copies"].to_numpy()
    scaled, given = unit(matrix(table["vec"].combine_chunks(), d))
    x = scaled @ axes[d]
    lead = min(LEAD, d)
    tail = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.column_stack([tail[:, at] for at in range(0, d, lead)] + [np.zeros(len(x))]))
    cut = int(np.searchsorted(block[order], lo, side="right"))
    left = range(0, cut, TILE)
    right = range(0, cut, TILE) if lo == hi else range(cut, len(x), TILE)
    end_left, end_right = cut, cut if lo == hi else len(x)
    links = np.zeros(len(x), dtype=np.int64)
    parent = np.arange(len(x))
    for p in left:
        for q in right:
            if lo == hi and q < p:
                continue
            a, b = slice(p, min(p + TILE, end_left)), slice(q, min(q + TILE, end_right))
            i, j, cos = _tile(x[a], x[b], rest[a], rest[b], lead, threshold - NEAR)
            i, j = i + p, j + q
            if lo == hi and p == q:
                upper = i < j
                i, j, cos = i[upper], j[upper], cos[upper]
            close = np.flatnonzero(np.abs(cos - threshold) <= NEAR)
            if len(close):
                u, v = given[i[close]], given[j[close]]
                cos[close] = np.einsum("ij,ij->i", u, v) / (
                    np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
            is_link = cos >= threshold
            i, j = i[is_link], j[is_link]
            if len(i):
                links += np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64)
                links += np.bincount(j, weights=copies[i], minlength=len(x)).astype(np.int64)
                parent = _join(parent, i, j)
    some = np.flatnonzero(links)
    return pa.table({"cls": cls[some], "links": links[some], "root": cls[parent[some]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 threshold: float = 0.9) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are linked when their cosine is at least ``threshold``; ``component_id`` is the
    smallest id reachable by links. Equal vectors are one class of the comparison and count
    as links of each other.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components
    are linked with nothing and stay; vectors of different lengths are not linked. Rows that
    repeat an id are vectors of their own. A null id is never the smallest unless it is alone.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = stored(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                                 F.monotonically_increasing_id().alias("row"),
                                 F.col(vec_col).alias("v")), "vectors")
    # the zero vector has no direction
    good = stored(usable(rows, "row", "v", zero=False).withColumnRenamed("vec_id", "row")
                  .withColumn("cls", F.xxhash64("vec")), "usable")
    classes = stored(good.groupBy("cls").agg(
        F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"),
        F.count(F.lit(1)).alias("copies")), "classes")
    n = classes.count()
    blocks = max(MIN_BLOCKS, -(-n // BLOCK))
    axes = principal_axes(classes)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    dealt = classes.withColumn("block", F.pmod(F.xxhash64(F.col("cls"), F.lit(1)), F.lit(blocks)).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = other.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    found = stored(pairs.groupBy("dim", "lo", "hi").applyInArrow(
        lambda t: _compare(t, shared.value, threshold), "cls bigint, links bigint, root bigint"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = components(found.select("cls", "root"), "cls", "root")
    per_class = classes.select("cls", "copies").join(links, "cls", "left") \
        .join(label.withColumnRenamed("id", "cls"), "cls", "left") \
        .select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "cls").alias("component"))
    member = rows.select("vec_id", "row").join(good.select("row", "cls"), "row", "left") \
                 .join(per_class, "cls", "left")
    low = member.filter("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("low"))
    out = member.join(low, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("component").isNotNull(), F.col("low")).otherwise(F.col("vec_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
