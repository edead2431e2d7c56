"""Throughput report as a Structured Streaming query.

Batch-log rows arrive as files; the report is a tumbling-window aggregate with a watermark.
``append`` mode emits a window once the watermark passes its end and drops rows behind the
watermark (Spark filters late rows with the previous batch's watermark);
``complete`` mode rewrites the whole (small) report every trigger. Output goes through
``foreachBatch`` to Parquet on shared storage -- never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def throughput_stream(log: DataFrame, interval: str, watermark: str) -> DataFrame:
    """Windowed tokens per interval over a streaming batch log (``ts`` timestamp)."""
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    agg = (log.withWatermark("ts", watermark)
              .groupBy(F.window("ts", interval).alias("w"))
              .agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_tokens").alias("tokens")))
    return agg.select(F.col("w.start").alias("window_start"), "n_batches", "tokens",
                      (F.col("tokens") / secs).alias("tokens_per_sec"))


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                   available_now: bool = True, timeout_s: float | None = None) -> None:
    """Run ``stream`` into Parquet at ``sink``. ``complete`` overwrites the sink per
    micro-batch; ``append``/``update`` write each micro-batch into its own ``epoch_id``
    partition with dynamic overwrite, so a micro-batch replayed after a failure replaces
    what its first attempt wrote instead of adding it twice. ``available_now`` processes
    what is there, then stops."""

    def write(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(sink)
            return
        (batch.withColumn("epoch_id", F.lit(epoch).cast("bigint")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("epoch_id").parquet(sink))

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    finish(w.start(), timeout_s)


def late_rows(log: DataFrame, report: DataFrame, interval: str) -> DataFrame:
    """What the watermark cost: ``window_start, n_logged, n_counted, n_late`` of the windows that
    an append-mode ``report`` has closed (those up to its last one, also if all their rows came
    late) and that miss rows of the ``log`` they were made from.
    Late rows leave no trace in the stream; the log, which stays, still has them."""
    logged = log.groupBy(F.window("ts", interval)["start"].alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_logged"))
    closed = logged.join(F.broadcast(report.agg(F.max("window_start").alias("_last"))),
                         F.col("window_start") <= F.col("_last")).drop("_last")
    counted = report.select("window_start", F.col("n_batches").alias("n_counted"))
    both = closed.join(counted, "window_start", "left").fillna(0, ["n_counted"])
    return both.withColumn("n_late", F.col("n_logged") - F.col("n_counted")).filter("n_late > 0")


def finish(query: StreamingQuery, timeout_s: float | None) -> None:
    """Waits for a stream; one that is still running after ``timeout_s`` seconds is stopped
    and reported, so that a partial result is never taken for a whole one."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {timeout_s} s; "
                           "its checkpoint lets it go on from there")


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                prepare: Callable[[DataFrame], DataFrame], max_files: int = 1) -> DataFrame:
    """Parquet files under ``path`` as a stream, ``max_files`` per micro-batch."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return prepare(raw)
