"""Sharding by longest-processing-time scheduling of groups that stay together.

Documents with equal texts are a group. Groups are placed largest first, each on the shard
that is least loaded so far, through a heap. Only the groups that are large against a shard are
placed one by one (at most ``shards * LARGE`` of them, by their definition); the others are
first collected into ``shards * BUCKETS`` hash buckets, which are then placed in the same way.
So the schedule has a bounded number of items whatever the number of groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import stored

LARGE = 256        # a group of more than 1 / LARGE of a shard is placed on its own
BUCKETS = 512      # hash buckets per shard for the other groups
RUN = 50_000       # rows numbered by one window run


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of every ``(size, item)``: largest first onto the least loaded shard (the lowest
    number among equals)."""
    load = [(0, s) for s in range(shards)]
    placed = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        total, s = heapq.heappop(load)
        placed[item] = s
        heapq.heappush(load, (total + size, s))
    return placed


def shard_by_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shards: int = 24, overhead: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row: sizes of the shards are nearly
    equal, equal texts share a shard, slots count from 0 without gaps in every shard.

    A size is the text's UTF-8 bytes plus ``overhead``. Defined cases: a null text has no
    bytes and shares a group with the empty texts; its checksum is 0. A group that alone is
    larger than a shard's part still stays whole. Repeated rows and null ids are rows like
    others (ties in a slot's order are broken by size, then arbitrarily among equal rows).
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("text"), text).alias("g2")), "sizes")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"))
    large = F.col("size") * (shards * LARGE) > F.lit(total or 0)
    bucket = F.pmod("g1", F.lit(shards * BUCKETS))
    items = groups.select(F.when(large, F.lit(None)).otherwise(bucket).cast("bigint").alias("bucket"),
                          F.when(large, F.col("g1")).alias("g1"), F.when(large, F.col("g2")).alias("g2"),
                          "size").groupBy("bucket", "g1", "g2").agg(F.sum("size").alias("size"))
    placed = longest_first([(r["size"], (r["bucket"], r["g1"], r["g2"])) for r in items.collect()], shards)
    # both tables have at most shards * (LARGE + BUCKETS) rows
    one = spark.createDataFrame([(g1, g2, s) for (b, g1, g2), s in placed.items() if b is None],
                                "g1 bigint, g2 bigint, _own int")
    many = spark.createDataFrame([(b, s) for (b, _, _), s in placed.items() if b is not None],
                                 "_bucket bigint, _shared int")
    dealt = rows.join(F.broadcast(one), ["g1", "g2"], "left") \
                .withColumn("_bucket", bucket).join(F.broadcast(many), "_bucket", "left") \
                .withColumn("shard", F.coalesce("_own", "_shared"))
    # slots: runs of rows, numbered by themselves and placed one after the other
    runs = max(4, -(-n // (shards * RUN)))
    dealt = dealt.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
    before = dealt.groupBy("shard", "_run").count().select(
        "shard", "_run", (F.sum("count").over(Window.partitionBy("shard").orderBy("_run"))
                          - F.col("count")).alias("_before"))
    order = Window.partitionBy("shard", "_run").orderBy("doc_id", "size", "text_crc32", "g1")
    return dealt.withColumn("_n", F.row_number().over(order) - 1) \
        .join(before, ["shard", "_run"]) \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_n")).alias("slot"))
