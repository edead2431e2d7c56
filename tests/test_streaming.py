"""Streams: watermark drops late rows (T1); replaying the soft-label stream is idempotent."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from seqlake.operators import probes as PR
from seqlake.session import scratch_path
from seqlake.sources import delta_store as DS
from seqlake.streaming.soft_labels import run_soft_label_stream
from seqlake.streaming.throughput import file_stream, late_rows, run_to_parquet, throughput_stream

SCHEMA = "ts timestamp, n_tokens long"


def _write(spark, path, times):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1) for m in times]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # distinct modification times: files are taken in that order


def test_append_mode_drops_rows_behind_the_watermark(spark):
    src = scratch_path(spark, "t1-src")
    # Spark filters late rows with the watermark of the batch before the one used for
    # eviction, so the late row comes two batches after the watermark moved past it.
    _write(spark, src, [10, 20, 70, 150])   # up to 02:30 -> watermark 02:20
    _write(spark, src, [200])               # 03:20 -> watermark 03:10
    _write(spark, src, [15])                # 00:15 is behind 02:20: dropped
    _write(spark, src, [300])               # 05:00 -> watermark 04:50 closes [03:00, 04:00)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = file_stream(spark, src, schema, lambda df: throughput_stream(df, "1 hour", "10 minutes"))
    sink = scratch_path(spark, "t1-sink")
    run_to_parquet(stream, sink, scratch_path(spark, "t1-ckpt"), mode="append")
    got = {r.window_start.hour: r.tokens for r in spark.read.parquet(sink).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1}


def test_late_rows_of_windows_that_were_never_reported(spark):
    """A closed window whose rows all came late counts none; windows behind the last one are open."""
    day = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(day + dt.timedelta(minutes=m), 1) for m in (10, 20, 70, 80, 150, 200)], SCHEMA)
    report = spark.createDataFrame([(day, 1), (day + dt.timedelta(hours=2), 1)], "window_start timestamp, n_batches long")
    got = {(r.window_start.hour, r.n_logged, r.n_counted, r.n_late) for r in late_rows(log, report, "1 hour").collect()}
    assert got == {(0, 2, 1, 1), (1, 2, 0, 2)}
    assert late_rows(log, report.limit(0), "1 hour").count() == 0


def test_soft_label_stream_replay_is_idempotent(spark):
    src = scratch_path(spark, "t2-src")
    df = spark.range(0, 200).select(F.col("id").alias("sample"),
                                    F.array(*[(F.col("id") * k).cast("float") for k in (1, 2, 3)])
                                    .alias("x"))
    df.repartition(4, F.col("sample") % 4).write.parquet(src)

    def prepare(s):
        scored = PR.score_batches(s, PR.linear_scorer([1.0, 0.0, 0.5]), "x", 3, "score")
        return scored.select("sample", (F.col("sample") / 25).cast("bigint").alias("batch_idx"),
                             "score")

    store = scratch_path(spark, "t2-store")
    for _ in range(2):   # second run = full replay with a fresh checkpoint
        stream = file_stream(spark, src, df.schema, prepare)
        run_soft_label_stream(stream, store, scratch_path(spark, "t2-ckpt"), ["sample"])
    back = DS.read_soft_labels(spark, store, ["sample"])
    assert back.count() == 200
    assert back.select("sample").distinct().count() == 200
    r = back.filter(F.col("sample") == 10).first()
    assert abs(r.score - (10 + 1.5 * 10)) < 1e-6 and r.batch_idx == 0


def test_unfinished_stream_is_an_error(spark):
    src = scratch_path(spark, "t1-slow")
    _write(spark, src, [10])
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = file_stream(spark, src, schema, lambda df: throughput_stream(df, "1 hour", "10 minutes"))
    with pytest.raises(TimeoutError):
        run_to_parquet(stream, scratch_path(spark, "t1-sink"), scratch_path(spark, "t1-ckpt"),
                       timeout_s=0.001)
