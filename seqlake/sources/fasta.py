"""A2: FASTA -> chunked sequence table ``(contig, chunk_id, chunk_start, seq)``.

A FASTA file is a list of records: a header line ``>name ...`` followed by sequence lines.
Finding the contig and the offset of every line needs the lines in order, and a record
usually spans many input splits. The scan therefore runs in two passes, never holding a
whole contig in one row:

1. JVM aggregates over the text splits give one summary row per split (headers seen,
   last header, bases after it, all bases). A window ordered by split start turns these
   into each split's carry-in (contig and offset at its first line). The table has exactly
   one row per input split -- the scheduler already tracks that many tasks -- so it is
   broadcast.
2. A second ``mapInPandas`` pass gives every line the header seen so far *inside its split*
   and the bases before it since that header (vectorised cumulative sums); the carry-in
   completes lines that precede the split's first header.

Lines are then cut into chunks of ``chunk_size`` bases; chunk ``k`` holds
``[k*chunk_size, (k+1)*chunk_size + overlap)``. With ``overlap >= tile_len - 1`` every tile
lies inside the chunk of its start, so the tile join (C1) is a plain equi-join. The
regrouping shuffle is keyed by (contig, chunk_id): a huge contig is spread over many keys.

Gzip input is not splittable; rewrite the chunk table once to Parquet (``read_through``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("contig", T.StringType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("chunk_start", T.LongType()),
    T.StructField("seq", T.StringType()),
])

_LOCAL_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("is_header", T.BooleanType()),
    T.StructField("local_contig", T.StringType()),
    T.StructField("seg", T.LongType()),
    T.StructField("local_off", T.LongType()),
    T.StructField("line", T.StringType()),
])


def _as_str(s: pd.Series) -> pd.Series:
    """Object dtype with None for missing (an all-missing column would otherwise turn into
    float NaN and fail the Arrow string conversion)."""
    s = s.astype(object)
    return s.where(s.notna(), None)


def _local_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-split running state, vectorised per Arrow batch.

    Rows of one split arrive in order and contiguously; a batch may hold the end of one
    split and the start of the next, and a split may span batches (state carried over).
    """
    state = None  # (file, block, seg, contig, off)
    for pdf in batches:
        if pdf.empty:
            continue
        key = pdf["file"].astype(str) + "\x00" + pdf["block"].astype(str)
        run_id = key.ne(key.shift()).cumsum()
        parts = []
        for _, g in pdf.groupby(run_id, sort=False):
            f, b = g["file"].iat[0], int(g["block"].iat[0])
            if state is not None and state[0] == f and state[1] == b:
                _, _, seg0, contig0, off0 = state
            else:
                seg0, contig0, off0 = 0, None, 0
            v = g["value"].str.rstrip("\r").reset_index(drop=True)
            hdr = v.str.startswith(">")
            n = v.str.len().where(~hdr, 0).astype("int64")
            seg = seg0 + hdr.cumsum().astype("int64")
            name = _as_str(v.str[1:].str.strip().str.split(n=1).str[0].where(hdr))
            contig = _as_str(name.ffill())
            if contig0 is not None:
                contig = contig.where(seg != seg0, contig0)
            off = n.groupby(seg).cumsum() - n
            off = off + off0 * (seg == seg0).astype("int64")
            m = len(v)
            parts.append(pd.DataFrame({
                "file": f, "block": b, "is_header": hdr, "local_contig": contig, "seg": seg,
                "local_off": off, "line": _as_str(v.where(~hdr))}))
            state = (f, b, int(seg.iat[-1]), contig.iat[-1] if m else contig0,
                     int(off.iat[-1] + n.iat[-1]))
        yield pd.concat(parts, ignore_index=True)


def split_summary(raw: DataFrame) -> DataFrame:
    """One row per input split: ``n_headers``, ``last_header``, ``tail_len`` (bases after
    the last header), ``lead_len`` (bases before the first) and ``total_len``, from JVM scans of the text only.

    Rows carry ``row`` = ``monotonically_increasing_id()``: inside a split it increases in
    line order, and every scan of the same files yields the same values. All aggregates
    are numeric (hash aggregation, partial per task); the header name comes from the few
    header lines.
    """
    v = F.rtrim(F.col("value"), F.lit("\r"))
    rows = raw.select("file", "block", F.monotonically_increasing_id().alias("row"),
                      v.startswith(">").alias("hdr"), v.alias("v"))
    n = F.when(F.col("hdr"), F.lit(0)).otherwise(F.length("v")).cast("long")
    per = rows.groupBy("file", "block").agg(
        F.count_if("hdr").alias("n_headers"),
        F.min(F.when(F.col("hdr"), F.col("row"))).alias("first_row"),
        F.max(F.when(F.col("hdr"), F.col("row"))).alias("last_row"),
        F.sum(n).alias("total_len"))
    # one row per split: bounded by the number of input splits
    tail = (rows.join(F.broadcast(per.select("file", "block", "first_row", "last_row")), ["file", "block"])
                .groupBy("file", "block")
                .agg(F.sum(F.when(F.col("row") > F.col("last_row"), n).otherwise(F.lit(0)))
                     .alias("tail_len"),
                     F.sum(F.when(F.col("first_row").isNull() | (F.col("row") < F.col("first_row")), n)
                           .otherwise(F.lit(0))).alias("lead_len")))
    names = rows.filter("hdr").select(
        "file", "block", F.col("row").alias("last_row"),
        F.regexp_extract(F.col("v"), r"^>\s*(\S*)", 1).alias("last_header"))
    return (per.join(tail, ["file", "block"])
               .join(names, ["file", "block", "last_row"], "left")
               .select("file", "block", "n_headers", "last_header", "tail_len", "lead_len", "total_len"))


def check_records(raw: DataFrame, blocks: DataFrame) -> None:
    """ValueError for records that would make sequences ambiguous: a header without a name, a
    name given twice (in any two files), bases before the first header of a file."""
    v = F.rtrim(F.col("value"), F.lit("\r"))
    names = raw.filter(v.startswith(">")).groupBy(F.regexp_extract(v, r"^>\s*(\S*)", 1).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    bad = names.filter("name = '' OR n > 1").first()
    if bad and not bad.name:
        raise ValueError(f"{bad.file}: a record without a name")
    if bad:
        raise ValueError(f"{bad.file}: {bad.n} records are named {bad.name!r}")
    first = blocks.groupBy("file").agg(F.min_by("lead_len", "block").alias("lead")).filter("lead > 0").first()
    if first:
        raise ValueError(f"{first.file}: bases before the first header")


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per sequence line: ``(contig, offset, line)``, offsets 0-based per contig."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    local = raw.mapInPandas(_local_pass, _LOCAL_SCHEMA)
    # Pass 1: one row per input split, JVM aggregates only; read by the check and by pass 2.
    blocks = split_summary(raw).checkpoint()
    check_records(raw, blocks)
    w = Window.partitionBy("file").orderBy("block")
    has_hdr = F.col("n_headers") > 0
    contrib = F.when(has_hdr, F.coalesce(F.col("tail_len"), F.lit(0))).otherwise(F.col("total_len"))
    blocks = blocks.withColumn("grp", F.sum(has_hdr.cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("run", F.sum(contrib).over(
        Window.partitionBy("file", "grp").orderBy("block")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("run_hdr", F.last("last_header", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carry = blocks.select(
        "file", "block",
        F.lag("run_hdr").over(w).alias("carry_contig"),
        F.coalesce(F.lag("run").over(w), F.lit(0)).alias("carry_off"))

    lines = local.filter(~F.col("is_header")).join(F.broadcast(carry), ["file", "block"], "left")
    return lines.select(
        F.when(F.col("seg") == 0, F.col("carry_contig")).otherwise(F.col("local_contig"))
         .alias("contig"),
        F.when(F.col("seg") == 0, F.col("carry_off") + F.col("local_off"))
         .otherwise(F.col("local_off")).alias("offset"),
        "line").filter(F.col("contig").isNotNull() & (F.length("line") > 0))


def chunk_lines(lines: DataFrame, chunk_size: int, overlap: int = 0) -> DataFrame:
    """Cut ``(contig, offset, line)`` rows into overlapping chunks (see module doc)."""
    c, v = int(chunk_size), int(overlap)
    o, n = F.col("offset"), F.length("line").cast("long")
    k_lo = F.greatest(F.lit(0).cast("long"), F.floor((o - F.lit(v)) / F.lit(c)).cast("long"))
    k_hi = F.floor((o + n - 1) / F.lit(c)).cast("long")
    ex = lines.select("contig", o.alias("o"), "line",
                      F.explode(F.sequence(k_lo, k_hi)).alias("chunk_id"))
    lo = F.greatest(F.col("o"), F.col("chunk_id") * c)
    hi = F.least(F.col("o") + F.length("line"), F.col("chunk_id") * c + c + v)
    pieces = ex.select("contig", "chunk_id", lo.alias("p_start"),
                       F.substring(F.col("line"), (lo - F.col("o") + 1).cast("int"),
                                   (hi - lo).cast("int")).alias("piece"))
    agg = pieces.groupBy("contig", "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("p_start", "piece"))).alias("ps"))
    return agg.select("contig", "chunk_id", (F.col("chunk_id") * c).alias("chunk_start"),
                      F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("seq"))


def fasta_scan(spark: SparkSession, path: str, chunk_size: int = 4096,
               overlap: int = 0) -> DataFrame:
    """A2: FASTA file(s) -> chunk table."""
    return chunk_lines(fasta_lines(spark, path), chunk_size, overlap)


def write_fasta(df: DataFrame, path: str, line_width: int = 60,
                contig_col: str = "contig", seq_col: str = "seq",
                order_by: list[str] | None = None) -> None:
    """Write ``(contig, seq)`` rows as FASTA, ``line_width`` bases per line."""
    body = F.regexp_replace(F.col(seq_col), f"(.{{{line_width}}})(?!$)", "$1\n")
    rec = F.concat(F.lit(">"), F.col(contig_col), F.lit("\n"), body)
    out = df.orderBy(*order_by) if order_by else df
    out.select(rec.alias("value")).write.mode("overwrite").text(path)


def contig_lengths(chunks: DataFrame) -> DataFrame:
    """length per contig. The last chunk ends at the contig end, overlap or not."""
    return chunks.groupBy("contig").agg(
        F.max(F.col("chunk_start") + F.length("seq")).cast("bigint").alias("length"))
