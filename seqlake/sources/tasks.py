"""A3: labelled tasks stored as Parquet partitioned by ``task_name`` and ``split``.

Reading one task and split prunes partitions; nothing else is listed or read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tasks(df: DataFrame, path: str) -> None:
    """Write partitioned by task and split. ``rebalance`` groups rows of a (task, split) on
    few writers, and AQE splits a (task, split) much larger than the rest over several
    tasks instead of one."""
    (df.hint("rebalance", "task_name", "split").write.mode("overwrite")
       .partitionBy("task_name", "split").parquet(path))


def task_scan(spark: SparkSession, path: str, tasks: Sequence[str] | None = None,
              splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Rows ``(task_name, split, sample_id, sequence, label)`` of the chosen tasks/splits."""
    df = spark.read.parquet(path)
    cond = F.col("split").isin(*splits)
    if tasks is not None:
        cond = cond & F.col("task_name").isin(*tasks)
    return df.filter(cond)
