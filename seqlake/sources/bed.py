"""A1: interval (BED) files -- tab separated, no header, four columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BED_SCHEMA = T.StructType([
    T.StructField("chr_name", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("split", T.StringType()),
])


def bed_scan(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """Read BED files with the fixed schema (never inferred).

    ``with_order`` adds ``file_order``: a key that sorts rows in file order (file path,
    then split start, then position inside the split) without a global sort.
    """
    df = spark.read.schema(BED_SCHEMA).option("sep", "\t").option("header", "false").csv(path)
    if with_order:
        df = df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("block"),
                                     F.monotonically_increasing_id().alias("row"))
                       .alias("file_order"))
    return df


def write_bed(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """Write intervals as BED. ``order_by`` range-partitions first so that part files, read
    back in name order, keep that order."""
    out = df
    if order_by:
        out = out.orderBy(*order_by)
    (out.select("chr_name", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "split")
        .write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path))
