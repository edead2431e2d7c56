"""Corpus pipeline: raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import prepare, stored, table
from seqlake.llm.line_dedup import dedup_lines
from seqlake.llm.mixing import poisson_mix
from seqlake.llm.near_dedup import drop_near_duplicates
from seqlake.llm.packing import pack
from seqlake.llm.quality import fit, held_out, score_quality
from seqlake.llm.queries import tokenizer_path

#: None: the stages have no form in SQL; they are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores at 0.5 or more. It learns from the
    labels that are not held out. Documents without a word are kept for no score to judge."""
    prepare(spark)
    labelled = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = fit(labelled, docs)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^ \x09-\x0D]"), F.lit(False))
    return score_quality(docs, model, score_col="_score").filter((F.col("_score") >= 0.5) | wordless) \
        .drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line. A document whose lines are all removed goes;
    one that had none stays as it is."""
    prepare(spark)
    out = dedup_lines(docs, lines_col="_lines", removed_col="_removed")
    return out.filter("_lines = 0 OR _removed < _lines").drop("_lines", "_removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: sets of five-word shingles with
    Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return drop_near_duplicates(docs, shingle=5, threshold=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources come out in proportion to the square root of
    their bytes, and shuffles them."""
    prepare(spark)
    return poisson_mix(docs, copy_col="_copy", key_col="_mix").drop("_copy", "_mix")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 ids (one row per piece)."""
    prepare(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
