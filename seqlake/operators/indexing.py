"""Global order, indices and batches.

The global index is never a ``row_number()`` without ``partitionBy`` (one task for the whole
table). Rows are range-partitioned on the order key, sorted inside each partition and
checkpointed to the shared checkpoint folder (so a lost executor recomputes nothing
differently); per-partition counts -- one row per partition -- give each partition its
offset.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.constants import DEFAULT_SKIP, LCG_A, LCG_C

_ROW_BITS = 33  # monotonically_increasing_id = partition id << 33 | row inside partition


def global_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order_by`` (must be unique)."""
    spark = df.sparkSession
    from seqlake.session import ensure_scratch
    ensure_scratch(spark)
    # Without an explicit count AQE sizes the range shuffle; coalescing merges adjacent
    # ranges, so partition order is still the global order.
    ordered = (df.repartitionByRange(num_partitions, *order_by) if num_partitions
               else df.repartitionByRange(*order_by)).sortWithinPartitions(*order_by)
    ordered = ordered.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _ROW_BITS)
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs on at most `n` rows.
    offsets = counts.select("_pid", (F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offsets = offsets.fillna(0, subset=["_off"])
    out = ordered.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid", "left")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return out.withColumn(name, F.col("_off") + local).drop("_mid", "_pid", "_off")


def batch(df: DataFrame, batch_size: int, idx: str = "idx", name: str = "batch_idx") -> DataFrame:
    """Consecutive rows in batches of ``batch_size``; the last one may be short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return df.withColumn(name, F.floor(F.col(idx) / F.lit(batch_size)).cast("bigint"))


def max_batches(df: DataFrame, n: int | None, batch_col: str = "batch_idx") -> DataFrame:
    """Only the first ``n`` batches (deterministic, unlike ``limit``)."""
    return df if n is None else df.filter(F.col(batch_col) < F.lit(n))


def resume_offset(df: DataFrame, global_step: int, accumulate: int, batch_size: int,
                  idx: str = "idx") -> DataFrame:
    """Restart after ``global_step`` optimizer steps: skip
    ``global_step * accumulate * batch_size`` samples."""
    start = int(global_step) * int(accumulate) * int(batch_size)
    return df.filter(F.col(idx) >= F.lit(start))


def warm_head(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """Materialise the first ``n`` samples (cached for repeated validation)."""
    return df.filter(F.col(idx) < F.lit(n)).cache()


def chunk_rounded_limit(df: DataFrame, limit: int, chunk: int, idx: str = "idx") -> DataFrame:
    """Keep ``ceil(limit / chunk) * chunk`` rows; ``limit == 0`` keeps everything."""
    if not limit:
        return df
    keep = -(-int(limit) // int(chunk)) * int(chunk)
    return df.filter(F.col(idx) < F.lit(keep))


def lcg_rank(idx: Column, m: int) -> Column:
    """``pmod(idx * A + C, m)`` computed in decimal(38, 0) (no bigint overflow)."""
    x = idx.cast("decimal(38,0)") * F.lit(LCG_A).cast("decimal(38,0)") + F.lit(LCG_C)
    return F.pmod(x, F.lit(m).cast("decimal(38,0)")).cast("bigint")


def _skip_table(df: DataFrame, skip: Iterable[int], idx: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(int(s),) for s in sorted(set(skip))], f"{idx} bigint")


def skip_anti(df: DataFrame, skip: Iterable[int] = DEFAULT_SKIP, idx: str = "idx") -> DataFrame:
    """Rows whose index is not in the skip list. The skip list is a user parameter of a
    handful of indices, hence the broadcast."""
    return df.join(F.broadcast(_skip_table(df, skip, idx)), idx, "left_anti")


def _kth_kept(r: int, skip_sorted: list[int], first: int = 0) -> int:
    """The ``r``-th (0-based) index of ``first, first + 1, ...`` that is not in ``skip_sorted``."""
    x = first + r
    for sk in skip_sorted:
        if sk < first:
            continue
        if sk <= x:
            x += 1
        else:
            break
    return x


def skip_substitute(df: DataFrame, skip: Iterable[int] = DEFAULT_SKIP, idx: str = "idx",
                    dense: bool = True) -> DataFrame:
    """Every row whose index is in the skip list is replaced by another, kept row.

    Reproducible rule: among the ``m`` kept rows (ranked by index), take the one of rank
    ``pmod(idx * 1103515245 + 12345, m)``. The replacement keeps the original ``idx``;
    ``source_idx`` says where the content came from.

    ``dense=True``: when the indices turn out to be consecutive (from any first index, so also
    after :func:`resume_offset`), the rank-to-index map follows from the skip list alone: one
    aggregate and a join with at most ``len(skip)`` target indices do it. Otherwise the kept
    rows are ranked with :func:`global_index`. Skip indices without a row replace nothing.
    """
    skip = sorted(set(int(s) for s in skip))
    kept = df.join(F.broadcast(_skip_table(df, skip, idx)), idx, "left_anti")
    out_kept = kept.withColumn("source_idx", F.col(idx))
    if dense:
        first, last, n = df.agg(F.min(idx), F.max(idx), F.count(F.lit(1))).first()
        dense = n == 0 or last - first + 1 == n
    if dense:
        present = [s for s in skip if n and first <= s <= last]
        m = n - len(present)
        if m <= 0 or not present:
            return out_kept
        pairs = [(s, _kth_kept((s * LCG_A + LCG_C) % m, skip, first)) for s in present]
        # at most len(skip) rows: the user's skip list
        want = df.sparkSession.createDataFrame(pairs, f"_orig bigint, {idx} bigint")
        repl = df.join(F.broadcast(want), idx, "inner")
    else:
        kept_ranked = global_index(kept, [idx], "_rank")
        m = kept_ranked.count()
        if m == 0:
            return out_kept
        skipped = df.filter(F.col(idx).isin(skip))
        want = skipped.select(F.col(idx).alias("_orig"), lcg_rank(F.col(idx), m).alias("_rank"))
        # `want` has at most len(skip) rows: the user's skip list.
        repl = kept_ranked.join(F.broadcast(want), "_rank", "inner").drop("_rank")
    repl = repl.withColumn("source_idx", F.col(idx)).withColumn(idx, F.col("_orig")).drop("_orig")
    return out_kept.unionByName(repl)
