"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import table
from seqlake.llm.divergence import divergence_oracle_sql, source_divergence
from seqlake.llm.licences import licence_digest, licence_oracle_sql, scan_licences
from seqlake.llm.line_dedup import dedup_lines
from seqlake.llm.mixing import mix_oracle_sql, poisson_mix
from seqlake.llm.near_dedup import near_duplicates
from seqlake.llm.packing import pack
from seqlake.llm.pii import find_personal_data
from seqlake.llm.quality import fit, held_out, score_quality
from seqlake.llm.sharding import shard_by_size
from seqlake.llm.topk_search import top_k
from seqlake.llm.variants import spelling_variants
from seqlake.llm.vector_dedup import near_vectors
from seqlake.llm.warc import read_archives, records, write_archives


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "copy", "source", "mix_key", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_quality(docs, fit(labelled, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(read_archives(write_archives(table(spark, sf_dir, "pages"))))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(scan_licences(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_personal_data, op3_topk_search, op4_near_dedup, op5_packing, op6_sharding,
    op7_mixing, op8_quality, op9_warc, op10_vector_dedup, op11_source_divergence, op12_spelling_variants, op13_licences)}

ORACLE = {"op7_mixing": mix_oracle_sql(), "op11_source_divergence": divergence_oracle_sql(),
          "op13_licences": licence_oracle_sql()}
