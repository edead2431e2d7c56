"""Classification metrics and result tables.

Zero denominators follow the usual library conventions: AUC is NaN when a group has a
single class, MCC and F1 are 0. ``try_divide`` is used so ANSI mode never raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.constants import HEADLINE_METRICS, RESULT_METRICS
from seqlake.operators.prefix import running_total

NAN = float("nan")
RESULT_KEYS = ("task_name", "model", "split", "metric")


def _below(df: DataFrame, by: Sequence[str], score: str, label: str, buckets: int | None = None,
           **counts: Column) -> DataFrame:
    """One row per (group, distinct score): ``_pos``, ``_neg``, the further ``counts`` and
    ``_below``, the negatives with a smaller score. The collapse is a partial aggregation and
    the only reading of ``df``; a group of any size is spread over range partitions."""
    y_pos = F.col(label) > 0
    d = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(y_pos).alias("_pos"), F.count_if(~y_pos).alias("_neg"),
        *[c.alias(n) for n, c in counts.items()])
    return running_total(d, by, "_s", "_neg", "_below", inclusive=False, buckets=buckets)


def _auc_sums() -> list[Column]:
    return [F.count_if(F.col("_s").isNull()).alias("_missing"),
            F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
            F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")]


def _auc() -> Column:
    return F.when((F.col("_p") > 0) & (F.col("_n") > 0) & (F.col("_missing") == 0),
                  F.col("_u") / (F.col("_p") * F.col("_n")).cast("double")).otherwise(F.lit(NAN))


def roc_auc(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label",
            buckets: int | None = None) -> DataFrame:
    """ROC AUC per group from a positive-class score; tied scores count one half. NaN
    for a group of one class or with a NULL score; a NULL group key is a group.

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2), divided by P * N, with
    the running negatives of :func:`seqlake.operators.prefix.running_total`.
    """
    by = list(by)
    return _below(df, by, score, label, buckets).groupBy(*by).agg(*_auc_sums()).select(
        *by, _auc().alias("roc_auc"))


def _confusion(pred: str, label: str) -> dict[str, Column]:
    y, p = F.col(label) > 0, F.col(pred) > 0
    return {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "tn": F.count_if(~y & ~p),
            "fn": F.count_if(y & ~p), "n_samples": F.count(F.lit(1)), "n_positive": F.count_if(y)}


def confusion_counts(df: DataFrame, by: Sequence[str], pred: str = "pred",
                     label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _confusion(pred, label).items()])


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def mcc(tp="tp", fp="fp", tn="tn", fn="fn") -> Column:
    """F16 from confusion counts (doubles before products); 0 on a zero denominator."""
    num = _d(tp) * _d(tn) - _d(fp) * _d(fn)
    den = F.sqrt((_d(tp) + _d(fp)) * (_d(tp) + _d(fn)) * (_d(tn) + _d(fp)) * (_d(tn) + _d(fn)))
    return F.coalesce(F.try_divide(num, F.when(den != 0, den)), F.lit(0.0))


def accuracy(tp="tp", tn="tn", n="n_samples") -> Column:
    """share of correct predictions."""
    return (_d(tp) + _d(tn)) / _d(n)


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """2TP / (2TP + FP + FN); 0 on a zero denominator."""
    den = 2 * _d(tp) + _d(fp) + _d(fn)
    return F.coalesce(F.try_divide(2 * _d(tp), F.when(den != 0, den)), F.lit(0.0))


def classification_metrics(df: DataFrame, by: Sequence[str], pred: str = "pred",
                           label: str = "label") -> DataFrame:
    """F16-F19 in one aggregation: mcc, accuracy, f1, n_samples, n_positive."""
    c = confusion_counts(df, by, pred, label)
    return c.select(*by, mcc().alias("mcc"), accuracy().alias("accuracy"), f1().alias("f1"),
                    "n_samples", "n_positive")


def evaluate(df: DataFrame, by: Sequence[str], score: str = "score", pred: str = "pred",
             label: str = "label") -> DataFrame:
    """All six metrics per group (wide). The confusion counts ride on the collapse that the AUC
    needs, so the input is read once and nothing is joined."""
    by, counts = list(by), _confusion(pred, label)
    agg = _below(df, by, score, label, **counts).groupBy(*by).agg(
        *_auc_sums(), *[F.sum(n).alias(n) for n in counts])
    return agg.select(*by, _auc().alias("roc_auc"), mcc().alias("mcc"), accuracy().alias("accuracy"),
                      f1().alias("f1"), "n_samples", "n_positive")


def results_long(wide: DataFrame, by: Sequence[str] = ("task_name", "model", "split")) -> DataFrame:
    """the six metrics as rows ``(task_name, model, split, metric, value)``."""
    cast = wide.select(*by, *[F.col(m).cast("double").alias(m) for m in RESULT_METRICS])
    return cast.unpivot(list(by), list(RESULT_METRICS), "metric", "value")


def headline_metrics(results: DataFrame, split: str = "test",
                     metrics: Sequence[str] = HEADLINE_METRICS) -> DataFrame:
    """Test-split AUC and F1, named ``nt_eval/{task}/{metric}``."""
    sel = results.filter((F.col("split") == split) & F.col("metric").isin(*metrics))
    return sel.select(F.concat_ws("/", F.lit("nt_eval"), "task_name", "metric").alias("name"),
                      "model", "value")


def compare_results(random: DataFrame, experiment: DataFrame, teacher: DataFrame,
                    keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Every random-baseline row, with the experiment's and the teacher's value for the
    same key (left joins; duplicated keys multiply, as a relational join does)."""
    keys = list(keys)
    r = random.select(*keys, F.col("value").alias("random"))
    e = experiment.select(*keys, F.col("value").alias("experiment"))
    t = teacher.select(*keys, F.col("value").alias("teacher"))
    return r.join(e, keys, "left").join(t, keys, "left")
