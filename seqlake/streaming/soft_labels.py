"""Score arriving rows and append them to the soft-label store, once each.

File stream -> H1 scoring (Arrow batches) -> ``foreachBatch``, one commit of the store per
micro-batch, named by the stream's checkpoint and the micro-batch number: one that is replayed
after a failure finds its commit and writes nothing, and all that was finished before an
interruption stays in the store. Rows sent again by another run (with a checkpoint of its own)
replace those with the same key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame

from seqlake.sources.delta_store import append_soft_labels
from seqlake.streaming.throughput import finish


def run_soft_label_stream(scored: DataFrame, store: str, checkpoint: str, key: Sequence[str],
                          timeout_s: float | None = None) -> None:
    """Runs the stream of scored rows into the store; ``key`` are the columns that name a row
    (with the block number, if a sample is stored in blocks)."""
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, epoch: int) -> None:
        append_soft_labels(batch, store, key, commit=f"{run}-{epoch}")

    q = (scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    finish(q, timeout_s)
