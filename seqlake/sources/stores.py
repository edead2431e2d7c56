"""Stores: read-through cache (A5), results CSV (A6). The soft-label store (A4) is in
:mod:`seqlake.sources.delta_store`.

All paths live on shared storage (by default below ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS_SCHEMA = T.StructType([
    T.StructField("task_name", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


_DONE: set[tuple[str, str]] = set()


def is_done(spark: SparkSession, path: str) -> bool:
    """True once :func:`mark_done` ran for ``path``. Spark hides ``_SUCCESS`` from its file
    listing, so completion is recorded as a visible marker written after the data job
    committed. Markers are never removed, so a positive answer is remembered."""
    key = (spark.sparkContext.applicationId, path)
    if key in _DONE:
        return True
    try:
        ok = spark.read.text(f"{path.rstrip('/')}.done").count() > 0
    except AnalysisException:
        return False
    if ok:
        _DONE.add(key)
    return ok


def mark_done(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([("done",)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path.rstrip('/')}.done")
    _DONE.add((spark.sparkContext.applicationId, path))


def cache_key(name: str, params: dict) -> str:
    """Path component that changes with every parameter (a different task group or limit
    never silently reuses old features)."""
    blob = json.dumps(params, sort_keys=True, default=str).encode()
    return f"{name}-{hashlib.sha1(blob).hexdigest()[:16]}"


def source_fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes whenever a file behind ``paths`` is added, removed or written anew: a hash of the
    names, sizes and modification times that the file system lists (no data is read)."""
    sc, seen = spark.sparkContext, []
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha1(json.dumps(sorted(seen)).encode()).hexdigest()[:16]


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """A5: build and write the table only if ``path`` has no finished output; then read it
    back from storage (lineage is cut there). What the table is made of belongs into ``path``: the
    parameters by :func:`cache_key`, the data by :func:`source_fingerprint`."""
    if not is_done(spark, path):
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        mark_done(spark, path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A6 sink: CSV with a header, no index column."""
    (df.select(*[F.col(f.name).cast(f.dataType) for f in RESULTS_SCHEMA.fields])
       .write.mode("overwrite").option("header", True).csv(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A6 scan: the results CSV with its fixed schema (never inferred)."""
    return (spark.read.schema(RESULTS_SCHEMA).option("header", True)
            .option("mode", "FAILFAST").csv(path))
