"""Order-dependent aggregates without a whole-group window in one task.

* :func:`running_total` -- exact cumulative sum in a total order inside each group.
* :func:`top_k` -- the k smallest rows per group, two phases over salted sub-groups.

A ``Window.partitionBy(group).orderBy(...)`` puts each group into one task; when one group
holds a third of the table that task is the whole job. Both helpers split a group first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import ensure_scratch


def running_total(df: DataFrame, by: Sequence[str], order_col: str, value_col: str,
                  out_col: str, inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """``out_col`` = sum of ``value_col`` over rows of the same group with a smaller
    ``order_col`` (and the row itself if ``inclusive``). ``order_col`` must be unique inside a
    group and may be of any type that sorts; a NULL group key is a group like any other.

    Rows are range-partitioned by group and order, so a group may span any number of
    partitions, and written to the checkpoint folder with their partition's number. The window
    runs per (partition, group); what a group has in earlier partitions is carried in. Only the
    first group of a partition can go on from an earlier one, so the carry table has at most
    one row per partition and is broadcast. ``df`` is evaluated once. ``buckets`` fixes the
    number of ranges, by default adaptive execution sizes them.
    """
    by = list(by)
    ensure_scratch(df.sparkSession)
    keys = [*by, order_col]
    ranged = df.repartitionByRange(buckets, *keys) if buckets else df.repartitionByRange(*keys)
    parts = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = parts.groupBy("_pid", *by).agg(F.sum(value_col).alias("_bt"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.sum("_bt").over(earlier)).filter("_carry IS NOT NULL")
    side = F.broadcast(carry.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_pid"]], "_carry"))
    same = F.lit(True)
    for c in [*by, "_pid"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_pid", *by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    out = parts.join(side, same, "left").withColumn(
        out_col, F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum(value_col).over(w), F.lit(0)))
    return out.select(*df.columns, out_col)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int,
          rank_col: str = "rank", salt_buckets: int = 16, salt_col: str | None = None) -> DataFrame:
    """Rows ranked ``1..k`` per group by ``order`` (ties broken by the order columns given).

    Phase 1 keeps the top k of each (group, salt) sub-group, phase 2 ranks the at most
    ``k * salt_buckets`` survivors per group. Exact: the global top k is inside the union
    of the sub-group top k's.
    """
    by = list(by)
    cols = [salt_col] if salt_col else df.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*by, "_salt").orderBy(*order)
    cand = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*by).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
