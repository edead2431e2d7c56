"""Run analytics over batch logs, step logs and parameter dumps.

Batch log: ``ts, batch_idx, n_tokens, device, core_util, mem_util``.
Step log: ``run, batch_idx, step, loss``.
Parameter dump: ``step, name, pos, value, grad`` (grad NULL = no gradient).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.constants import UPDATE_RATIO_EPS
from seqlake.operators.prefix import running_total


def _seconds(interval: str) -> float:
    n, unit = interval.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return float(n) * mult


def throughput(log: DataFrame, interval: str, total_batches: int) -> DataFrame:
    """F21, per interval: batches, tokens, tokens per second and percent done.

    Intervals are aligned tumbling windows (the reference's timer drifts); the run total is
    a parameter. Percent done needs the batches of all earlier intervals: an exact running
    total over one row per window, split into buckets (no single-task window).
    """
    per = log.groupBy(F.window("ts", interval).alias("w")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_tokens").alias("tokens"))
    per = per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "n_batches", "tokens",
                     (F.col("tokens") / F.lit(_seconds(interval))).alias("tokens_per_sec"))
    per = per.withColumn("_one", F.lit(1))
    per = running_total(per, ["_one"], "window_start", "n_batches", "done_batches")
    return per.select("window_start", "window_end", "n_batches", "tokens", "tokens_per_sec",
                      (F.col("done_batches") / F.lit(total_batches) * 100.0).alias("percent_done"))


def throughput_total(log: DataFrame, total_batches: int) -> DataFrame:
    """F21, whole run: batches, tokens, elapsed seconds, average tokens per second."""
    elapsed = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    agg = log.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_tokens").alias("tokens"),
                  elapsed.alias("elapsed_sec"))
    return agg.select("n_batches", "tokens", "elapsed_sec",
                      F.try_divide(F.col("tokens"), F.col("elapsed_sec")).alias("avg_tokens_per_sec"),
                      (F.col("n_batches") / F.lit(total_batches) * 100.0).alias("percent_done"))


def device_utilisation(log: DataFrame, interval: str) -> DataFrame:
    """mean core and memory utilisation per device per interval. An interval without
    samples has no row (the reference prints 0)."""
    agg = log.groupBy(F.window("ts", interval).alias("w"), "device").agg(
        F.avg("core_util").alias("avg_core_util"), F.avg("mem_util").alias("avg_mem_util"),
        F.count(F.lit(1)).alias("n_samples"))
    return agg.select(F.col("w.start").alias("window_start"), "device", "avg_core_util",
                      "avg_mem_util", "n_samples")


# ---------------------------------------------------------------- S4 + F23

_LAYER_RE = r"^(?:[^.]*\.)*?layers\.([^.]*)(?:\.(.*))?$"


def parameter_label(name: Column, suffixes: Sequence[str], embedding_marker: str,
                    submodule_prefix: str) -> Column:
    """Metric prefix of a parameter name, NULL when it is not tracked.

    A name ending in one of ``suffixes`` becomes ``diag/L{layer}/{rest}``: ``layer`` is the
    component after the first ``layers`` component (must be an integer, else dropped),
    ``rest`` the components after it with ``submodule_prefix`` removed. A name containing
    ``embedding_marker`` becomes ``diag/embed``.
    """
    significant = F.lit(False)
    for s in suffixes:
        significant = significant | name.endswith(s)
    has_layers = name.rlike(r"(^|\.)layers\.")
    layer_txt = F.regexp_extract(name, _LAYER_RE, 1)
    rest = F.replace(F.regexp_extract(name, _LAYER_RE, 2), F.lit(submodule_prefix), F.lit(""))
    layer_ok = layer_txt.rlike(r"^[+-]?[0-9]+$")
    layer = F.concat(F.lit("diag/L"), layer_txt.cast("bigint").cast("string"), F.lit("/"), rest)
    return (F.when(significant & has_layers & layer_ok, layer)
             .when(significant, F.lit(None).cast("string"))
             .when(name.contains(embedding_marker), F.lit("diag/embed")))


def parameter_stats(dump: DataFrame, lr: float, by: Sequence[str] = ("step", "name")) -> DataFrame:
    """per parameter: L2 norms of gradient and weight, and the update ratio
    ``lr * std(grad) / (std(weight) + 1e-8)`` (0 when the weight's sample std is 0).
    Parameters without gradient are skipped. One aggregation, partial per task."""
    has_grad = dump.groupBy(*by).agg(F.count_if(F.col("grad").isNull()).alias("_nulls"),
                                     F.sqrt(F.sum(F.col("grad") ** 2)).alias("grad_norm"),
                                     F.sqrt(F.sum(F.col("value") ** 2)).alias("weight_norm"),
                                     F.stddev_samp("value").alias("_sw"),
                                     F.stddev_samp("grad").alias("_sg"))
    ratio = F.when(F.col("_sw") > 0, F.lit(lr) * F.col("_sg") / (F.col("_sw") + UPDATE_RATIO_EPS)) \
             .otherwise(F.lit(0.0))
    return has_grad.filter(F.col("_nulls") == 0).select(
        *by, "grad_norm", "weight_norm", ratio.alias("update_ratio"))


# ---------------------------------------------------------------- schedules

def _max_step(n_batches: Column, accumulate: int, epochs: int) -> Column:
    return (F.ceil(n_batches / F.lit(accumulate)) * F.lit(epochs)).cast("bigint")


def schedule_linear(step_log: DataFrame, interval: int, accumulate: int, epochs: int = 1) -> DataFrame:
    """``range(interval, max_step, interval)`` with
    ``max_step = ceil(train_batches / accumulate) * epochs`` (train batches from the log)."""
    m = step_log.agg(_max_step(F.count(F.lit(1)), accumulate, epochs).alias("m"))
    seq = F.when(F.col("m") > interval,
                 F.sequence(F.lit(interval).cast("bigint"), F.col("m") - 1, F.lit(interval).cast("bigint"))) \
           .otherwise(F.array().cast("array<bigint>"))
    return m.select(F.explode(seq).alias("step"))


def schedule_log(step_log: DataFrame, lo: float, accumulate: int, epochs: int = 1,
                 every: int = 100) -> DataFrame:
    """Distinct ``floor(10^x)`` for ``num`` evenly spaced exponents ``x`` in
    ``[lo, hi]``; ``hi`` is ``log10(max_step - 1)``, so the last step is ``max_step - 1``, and
    ``num = max_step // every`` (explicit exponents, see Q8). Fewer than ``every`` steps give no
    row and fewer than ``2 * every`` the first step only, as there is one exponent then."""
    m = step_log.agg(_max_step(F.count(F.lit(1)), accumulate, epochs).alias("m"))
    m = m.filter("m > 1").select("m", F.log10(F.col("m") - 1).alias("hi"),
                 F.floor(F.col("m") / every).cast("int").alias("num"))
    i = F.explode(F.sequence(F.lit(0), F.col("num") - 1)).alias("i")
    x = m.filter(F.col("num") > 0).select("m", "hi", "num", i)
    step = (F.col("hi") - F.lit(lo)) / (F.col("num") - 1)
    expo = F.when(F.col("i") == F.col("num") - 1, F.col("hi")) \
            .otherwise(F.lit(lo) + F.col("i") * step)
    expo = F.when(F.col("num") == 1, F.lit(lo)).otherwise(expo)
    # the end point is exact, whatever 10 ** log10 rounds to
    last = (F.col("num") > 1) & (F.col("i") == F.col("num") - 1)
    return x.select(F.when(last, F.col("m") - 1).otherwise(F.floor(F.pow(F.lit(10.0), expo)))
                    .cast("bigint").alias("step")).distinct()


def sorted_schedule(schedule: DataFrame) -> DataFrame:
    """Ascending steps with their position. The schedule is a few hundred rows."""
    return schedule.withColumn("pos", F.row_number().over(Window.orderBy("step")) - 1)


def schedule_semi(step_log: DataFrame, schedule: DataFrame) -> DataFrame:
    """Step-log rows whose step is in the schedule (left semi join; AQE broadcasts the
    schedule once it has measured it)."""
    return step_log.join(schedule.select("step").distinct(), "step", "left_semi")


def first_per_step(step_log: DataFrame, schedule: DataFrame, offset: int = 0,
                   by: Sequence[str] = ("run",), dense: bool | None = None) -> DataFrame:
    """G1: fire once per optimizer step although several batches share it.

    A row fires when ``step + offset`` is in the schedule and is greater than the previous
    row's ``step + offset`` (the first row compares with -1). ``offset = -1`` is the
    validation variant. The previous row is the row with position ``- 1`` in the same run,
    found by an equi-join -- no window over a whole run. ``dense=True``: ``batch_idx`` counts
    without gaps inside each run and is the position; ``False``: positions are assigned by the
    global index over ``(run, batch_idx)``; ``None``: the counters are checked first (one
    aggregate per run).
    """
    by = list(by)
    if dense is None:
        per = step_log.groupBy(*by).agg(
            (F.max("batch_idx") - F.min("batch_idx") + 1 != F.count(F.lit(1))).alias("_gap"))
        dense = per.filter(F.coalesce("_gap", F.lit(True))).isEmpty()
    cur = step_log.withColumn("_s", F.col("step") + F.lit(offset))
    if dense:
        cur = cur.withColumn("_p", F.col("batch_idx"))
    else:
        from seqlake.operators.indexing import global_index
        cur = global_index(cur, [*by, "batch_idx"], "_p")
    prev = cur.select(*by, (F.col("_p") + 1).alias("_p"), F.col("_s").alias("_prev"))
    j = cur.join(prev, [*by, "_p"], "left").drop("_p")
    j = j.withColumn("_prev", F.coalesce(F.col("_prev"), F.lit(-1)))
    fired = j.filter(F.col("_s") > F.col("_prev")).drop("_prev")
    sched = schedule.select(F.col("step").alias("_s")).distinct()
    return fired.join(sched, "_s", "left_semi").drop("_s")


def best_checkpoints(val_log: DataFrame, k: int = 3, by: Sequence[str] = ("run",)) -> DataFrame:
    """The ``k`` rows with the smallest validation loss per run (ties by step, then
    batch), plus the latest step's row (``kind = 'last'``)."""
    by = list(by)
    # k rows per task survive the shuffle (window group limit); NULL and NaN losses rank last
    order = Window.partitionBy(*by).orderBy(F.col("loss").asc_nulls_last(), "step", "batch_idx")
    best = val_log.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .withColumn("kind", F.lit("top"))
    last_row = val_log.groupBy(*by).agg(
        F.max_by(F.struct(*[c for c in val_log.columns if c not in by]),
                 F.struct("step", "batch_idx")).alias("_r"))
    last = last_row.select(*by, "_r.*").withColumn("rank", F.lit(None).cast("int")) \
        .withColumn("kind", F.lit("last"))
    return best.unionByName(last)


def checkpoint_name(epoch: Column, loss: Column, step: Column, template: str) -> Column:
    """S3: checkpoint file name (``format_string``; ties round half up)."""
    return F.format_string(template, epoch, loss, step)


def run_name(ts: Column, suffix: Column) -> Column:
    """``yyyyMMdd_HHmm`` in UTC (the session time zone), ``_suffix`` when non-empty."""
    base = F.date_format(ts, "yyyyMMdd_HHmm")
    return F.when(F.coalesce(F.length(suffix), F.lit(0)) > 0, F.concat_ws("_", base, suffix)) \
            .otherwise(base)


def metric_name(*parts: Column | str) -> Column:
    """Slash-joined metric name."""
    return F.concat_ws("/", *[F.col(p) if isinstance(p, str) else p for p in parts])
