"""Feature sets and label profiling.

Feature set layout: ``task_name, split, sample_id, feature (array<double>), label`` plus an
optional ``sample_idx`` giving the order in which samples were produced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("task_name", "split")


def task_groups(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """M10 as a dimension table ``(task_group, pos, task_name)`` from the caller's named,
    ordered task lists (configuration)."""
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "task_group string, pos int, task_name string")


def task_group(df: DataFrame, groups: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    """Keep rows whose task is in ``group``; only its first ``limit`` tasks if > 0.

    The dimension table is user-defined configuration (a few tasks per group): broadcast.
    """
    sel = groups.filter(F.col("task_group") == F.lit(group))
    if limit is not None and limit > 0:
        sel = sel.filter(F.col("pos") < F.lit(limit))
    return df.join(F.broadcast(sel.select("task_name")), "task_name", "left_semi")


def assign(df: DataFrame, **constants) -> DataFrame:
    """Constant columns (e.g. ``split='train', task_name='enhancers'``)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def feature_concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack (task, split) feature sets by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def task_outcomes(features: DataFrame, tasks: DataFrame, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """D6, what became of every listed task: ``task_name, status, n_samples, n_failed, detail``.

    ``failed``: a sample has an ``error``, no feature, or a feature whose length differs from
    others of its task (``detail``: the smallest error text, ``no feature`` or ``ragged``);
    ``empty``: it has no sample in one of ``splits`` (``detail``: those splits); else ``ok``. A
    failure outranks an empty split. ``error`` is the text that the featuriser left, NULL if it
    had no trouble with the sample. ``tasks`` (``task_name``) is the caller's list.
    """
    width = F.size("feature")
    per = features.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("error").isNotNull() | F.col("feature").isNull()).alias("n_failed"),
        F.min(F.coalesce("error", F.when(F.col("feature").isNull(), "no feature"))).alias("_why"),
        (F.min(F.when(F.col("feature").isNotNull(), width)) != F.max(width)).alias("_ragged"),
        *[F.count_if(F.col("split") == s).alias(f"_in_{s}") for s in splits])
    out = tasks.select("task_name").distinct().join(per, "task_name", "left")
    bad = (F.coalesce("n_failed", F.lit(0)) > 0) | F.coalesce("_ragged", F.lit(False))
    missing = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"_in_{s}"), F.lit(0)) == 0, s) for s in splits])
    status = F.when(bad, "failed").when(missing != "", "empty").otherwise("ok")
    return out.select(
        "task_name", status.alias("status"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.when(bad, F.coalesce("_why", F.lit("ragged"))).when(missing != "", missing).alias("detail"))


def concat_tasks(parts: Sequence[DataFrame], tasks: DataFrame,
                 splits: Sequence[str] = ("train", "test")) -> tuple[DataFrame, DataFrame]:
    """D6 with roll-back: the stacked features of the listed tasks that are ``ok``, and the
    outcome of all (:func:`task_outcomes`). A task that failed in any split goes as a whole.
    The outcomes have one row per listed task (the caller's configuration): broadcast."""
    rows = feature_concat(parts)
    outcomes = task_outcomes(rows, tasks, splits)
    good = outcomes.filter("status = 'ok'").select("task_name")
    return rows.join(F.broadcast(good), "task_name", "left_semi").drop("error"), outcomes


def max_pool_blocks(blocks: DataFrame, keys: Sequence[str], dims: int, states: str = "states") -> DataFrame:
    """E5 over states that are stored in blocks of positions: ``keys, dim, value``.

    A row holds the states of some positions of a sample, position by position, flattened to
    ``dims`` numbers each. Every task keeps the maximum per (sample, dimension) of what it has
    read and one aggregate merges them, so no row ever holds a whole ``[T][D]`` state. NULL
    numbers are left out; a dimension with none but NULLs has a NULL maximum. A block whose
    length is no multiple of ``dims`` raises.
    """
    whole = F.when(F.size(states) % dims != 0, F.raise_error(F.concat(
        F.lit(f"a block has a length that is no multiple of {dims}: "), F.size(states)))).otherwise(F.col(states))
    each = blocks.select(*keys, F.posexplode(whole).alias("_i", "_v"))
    return each.groupBy(*keys, F.pmod("_i", F.lit(dims)).alias("dim")).agg(F.max("_v").alias("value"))


def max_pool(states: Column) -> Column:
    """E5: element-wise max over the sequence axis of ``array<array<double>>`` ``[T][D]``,
    in-row (no shuffle, no PAD mask)."""
    return F.aggregate(F.slice(states, 2, 1 << 30), F.element_at(states, 1),
                       lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b)))


def reshape(flat: Column, rows: int, cols: int) -> Column:
    """Flat array -> ``rows x cols`` nested array (row-major)."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda r: F.slice(flat, r * cols + 1, cols))


# ---------------------------------------------------------------- F9-F14

def label_unique(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """sorted distinct labels per (task, split). Distinct first, so the set collected per
    group is bounded by the number of distinct labels, not by the group size."""
    d = df.select(*by, "label").distinct()
    return d.groupBy(*by).agg(F.sort_array(F.collect_list("label")).alias("labels"))


def label_types(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """count of labels per value type."""
    return df.groupBy(*by, F.typeof("label").alias("label_type")).agg(
        F.count(F.lit(1)).alias("count"))


def label_frequencies(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """count and share of each label per (task, split). The share's window runs on the
    aggregated counts (one row per label)."""
    c = df.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def label_null_check(df: DataFrame, by: Sequence[str] = KEY, strict: bool = False) -> DataFrame:
    """null labels per group; ``strict`` raises when there is any."""
    out = df.groupBy(*by).agg(F.count_if(F.col("label").isNull()).alias("n_null"))
    if strict:
        n = out.agg(F.sum("n_null")).first()[0]
        if n:
            raise ValueError(f"found {n} null labels")
    return out


def distinct_tasks(df: DataFrame, order_col: str = "sample_idx") -> DataFrame:
    """tasks in first-seen order (position 0, 1, ...). The window runs on one row per
    task."""
    first = df.groupBy("task_name").agg(F.min(order_col).alias("first_idx"))
    return first.withColumn("task_pos", (F.row_number().over(Window.orderBy("first_idx")) - 1))


def label_gate(df: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """per task, the decision taken before fitting probes.

    ``error`` if the task has no samples, if its train split has more than two labels, or if
    (with several tasks) it holds every sample; ``skip`` if fewer than two train labels;
    else ``ok``. ``tasks`` (``task_name``) lists the tasks to decide on, by default those that
    occur; only a listed one can be without samples.
    """
    per_task = df.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_distinct(F.when(F.col("split") == "train", F.col("label"))).alias("n_train_labels"))
    if tasks is not None:
        per_task = tasks.select("task_name").distinct().join(per_task, "task_name", "left").fillna(0)
    # One row per task: the totals window is as small as the task list.
    everything = Window.partitionBy()
    out = per_task.withColumns({"n_total": F.sum("n_samples").over(everything),
                                "n_tasks": F.count(F.lit(1)).over(everything)})
    status = (F.when(F.col("n_samples") == 0, "error")
              .when((F.col("n_tasks") > 1) & (F.col("n_samples") >= F.col("n_total")), "error")
              .when(F.col("n_train_labels") > 2, "error")
              .when(F.col("n_train_labels") < 2, "skip").otherwise("ok"))
    return out.select("task_name", "n_samples", "n_train_labels", status.alias("status"))
