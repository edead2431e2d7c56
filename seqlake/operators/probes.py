"""Model-shaped operators on tables (H1-H4).

H1 applies a user-supplied frozen model to batches of rows through Arrow
(``predict_batch_udf``): the model is built once per Python worker and fed numpy batches.
H2-H4 fit probes with Spark ML; fitting and scoring are distributed, the loop over the few
tasks runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.constants import POSITION_BLOCK
from seqlake.operators.labels import label_gate
from seqlake.operators.metrics import evaluate, results_long
from seqlake.session import scratch_path

OUT_BYTES = 4 << 20             # of position outputs per Arrow batch


def score_batches(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  input_col: str, width: int, output_col: str = "score",
                  batch_size: int = 256, return_type: T.DataType = T.DoubleType()) -> DataFrame:
    """H1: ``output_col = model(input_col)`` in Arrow batches of ``batch_size`` rows.

    ``make_predict_fn`` runs once per Python worker and returns ``f(x: ndarray[B, width])``.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=[[width]])
    return df.withColumn(output_col, udf(F.col(input_col)))


def score_token_positions(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                          keep: Sequence[str], ids_col: str = "ids", batch_size: int = 8,
                          block: int = POSITION_BLOCK) -> DataFrame:
    """H1 with per-position outputs (M6): one row per tile and ``block`` positions with the
    columns ``keep``, ``block``, ``input_ids`` and ``logits`` (position by position, flattened).

    ``make_predict_fn`` runs once per task and returns ``f(x: ndarray[B, L]) -> ndarray[B, L, C]``;
    it gets up to ``batch_size`` tiles of one length, whatever the Arrow batches hold. Tiles
    without ids keep one row with empty arrays.
    """
    names = list(keep)
    schema = T.StructType([df.schema[c] for c in names] + [
        T.StructField("block", T.IntegerType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("logits", T.ArrayType(T.FloatType()))])

    def lists(parts: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([p.reshape(len(p), int(np.prod(p.shape[1:]))) for p in parts])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]),
                                        pa.array(flat.ravel()))

    def blocks_of(batch: pa.RecordBatch, rows: np.ndarray, x: list[np.ndarray], y: list[np.ndarray],
                  length: int) -> Iterator[pa.RecordBatch]:
        kept = [batch.column(c).take(pa.array(rows)) for c in range(len(names))]
        for b in range(max(-(-length // block), 1)):
            part = slice(b * block, (b + 1) * block)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(len(rows), b, dtype=np.int32)), lists([v[:, part] for v in x]),
                 lists([v[:, part] for v in y])], names=[*names, "block", "input_ids", "logits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_predict_fn()
        for batch in batches:
            ids = [s or "" for s in batch.column(len(names)).to_pylist()]
            lens = np.array([len(s) for s in ids])
            for length in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == length)
                first, held, xs, ys = 0, 0, [], []      # the model's batches are small: sent on together
                for i in range(0, len(rows), batch_size):
                    some = rows[i:i + batch_size]
                    x = np.frombuffer("".join(ids[r] for r in some).encode("ascii"), dtype=np.uint8)
                    x = x.reshape(len(some), length).astype(np.int32) - 48
                    y = np.asarray(fn(x), dtype=np.float32) if length else np.empty((len(some), 0, 0), np.float32)
                    xs.append(x)
                    ys.append(y)
                    held += x.nbytes + y.nbytes
                    if held >= OUT_BYTES or i + batch_size >= len(rows):
                        yield from blocks_of(batch, rows[first:i + batch_size], xs, ys, length)
                        first, held, xs, ys = i + batch_size, 0, [], []

    return df.select(*names, ids_col).mapInArrow(run, schema)


def linear_scorer(weights: Sequence[float]) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A fixed linear map, packaged as a model factory for :func:`score_batches`."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return x.astype(np.float64) @ w
        return predict

    return make


# ---------------------------------------------------------------- H2, H3

def _vec(df: DataFrame, col: str = "feature") -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(col)))


def probe_lreg(train: DataFrame, seed: int = 0, cs: Sequence[float] = tuple(np.logspace(-4, 4, 10)),
               folds: int = 5, max_iter: int = 1000):
    """H2: standardise, then L2 logistic regression with ``folds``-fold CV over inverse
    regularisation strengths ``cs`` (``regParam = 1 / (C * n)``), selected by accuracy."""
    n = train.count()
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="_scaled", labelCol="label", maxIter=max_iter,
                            elasticNetParam=0.0)
    pipe = Pipeline(stages=[scaler, lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * max(n, 1)) for c in cs]).build()
    # the grid's fits are independent Spark jobs: run a few at a time
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, numFolds=folds, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"),
                        parallelism=min(4, len(grid)))
    return cv.fit(_vec(train).withColumn("label", F.col("label").cast("double")))


def probe_gbrt(train: DataFrame, seed: int = 0, max_iter: int = 100):
    """H3: gradient-boosted trees, seeded."""
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", seed=seed, maxIter=max_iter)
    return gbt.fit(_vec(train).withColumn("label", F.col("label").cast("double")))


def predict(model, df: DataFrame) -> DataFrame:
    """Positive-class probability as ``score`` and the hard prediction as ``pred``."""
    out = model.transform(_vec(df))
    return out.select(*[c for c in df.columns],
                      vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("pred"))


# ---------------------------------------------------------------- H4

#: Fits on a train split; the result adds ``score`` and ``pred`` to any feature set.
Fitter = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]

SCORE_COLUMNS = ("task_name", "model", "split", "sample_id", "label", "score", "pred")


def standard_fitters(seed: int = 0, gbrt_only: bool = False, lreg_cs: Sequence[float] = tuple(np.logspace(-4, 4, 10)),
                     folds: int = 5, gbrt_iter: int = 100) -> dict[str, Fitter]:
    """H2 and H3 as fitters for :func:`score_probes`."""
    out: dict[str, Fitter] = {"gbrt": lambda train: partial(predict, probe_gbrt(train, seed, gbrt_iter))}
    if not gbrt_only:
        out["lreg"] = lambda train: partial(predict, probe_lreg(train, seed, lreg_cs, folds))
    return out


def score_probes(features: DataFrame, path: str, fitters: dict[str, Fitter]) -> DataFrame:
    """H4 up to the metrics: the score table (:data:`SCORE_COLUMNS`), written to ``path`` and read
    back. Per task every model is fitted on ``split = 'train'`` and applied once to every row;
    everything that is not train counts as ``test``.

    The label gate (F14) decides first: ``skip`` tasks are left out, ``error`` raises.
    """
    gate = label_gate(features).collect()  # one row per task
    errors = [r.task_name for r in gate if r.status == "error"]
    if errors:
        raise ValueError(f"label gate failed for tasks {errors}")
    kinds = features.select("task_name", F.lit("").alias("model"), "split", "sample_id", "label",
                            F.lit(0.0).alias("score"), F.lit(0).alias("pred"))
    kinds.limit(0).write.parquet(path)
    for task in sorted(r.task_name for r in gate if r.status == "ok"):
        ds = features.filter(F.col("task_name") == task)
        ds = ds.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
        # all fits come first: one that fails leaves no scores of the task behind
        models = {name: fit(ds.filter(F.col("split") == "train")) for name, fit in fitters.items()}
        for name, model in models.items():
            scored = model(ds).withColumn("model", F.lit(name))
            scored.select(*[F.col(c).cast(kinds.schema[c].dataType) for c in SCORE_COLUMNS]) \
                .write.mode("append").parquet(path)
    return features.sparkSession.read.schema(kinds.schema).parquet(path)


def probe_results(scores: DataFrame) -> DataFrame:
    """H4, the metrics: six per (task, model, split) as long rows, from one reading of the score
    table."""
    return results_long(evaluate(scores, ["task_name", "model", "split"]))


def run_probes(features: DataFrame, seed: int = 0, gbrt_only: bool = False,
               lreg_cs: Sequence[float] = tuple(np.logspace(-4, 4, 10)), folds: int = 5,
               gbrt_iter: int = 100, path: str | None = None) -> DataFrame:
    """H4: :func:`score_probes` with H2 and H3, then :func:`probe_results`. The score table stays
    at ``path`` (default: a new folder below the scratch root)."""
    fitters = standard_fitters(seed, gbrt_only, lreg_cs, folds, gbrt_iter)
    return probe_results(score_probes(features, path or scratch_path(features.sparkSession, "scores"), fitters))
