"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source has a target share of the output's bytes; its rate is the mean number of copies
that each of its documents needs for that. A document's number of copies is drawn by inverting
the Poisson distribution of that mean at a uniform number made from a hash of seed and id, so
it depends on nothing but seed, id and rate. The copies are dealt to partitions and ordered
inside them by a hash of seed, id and copy number: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import fresh

PART = 500.0                 # larger means are drawn as sums of parts of at most this mean
BROADCAST_SOURCES = 100_000  # sources up to which the table of rates is broadcast


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by colons."""
    text = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to 12 deviations beyond the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.exp(-rate)

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    first = F.struct(zero.alias("p"), F.array(zero).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text",
                 weights: Mapping[str | None, float] | None = None,
                 budget_bytes: int | None = None) -> DataFrame:
    """``source, bytes, rate`` of every source. Target shares are ``weights`` (sources that are
    not listed get 0), or proportional to the square root of the sources' bytes, which lifts
    small sources. The output aims at ``budget_bytes``, by default the bytes there are."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        weight = F.sqrt(F.col("bytes").cast("double"))
    else:
        weight = F.lit(0.0)
        for s, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(weight)
    per = per.withColumn("_w", F.when(F.col("bytes") > 0, weight).otherwise(0.0))
    # one row per source, and one of totals
    total = per.agg(F.sum("_w").alias("_sw"), F.sum("bytes").alias("_sb"))
    sums = total.first()
    if not sums["_sw"]:
        return per.select("source", "bytes", F.lit(1.0).alias("rate"))
    aim = float(sums["_sb"] if budget_bytes is None else budget_bytes)
    rate = F.when(F.col("bytes") > 0, F.lit(aim) * F.col("_w") / F.lit(float(sums["_sw"]))
                  / F.col("bytes").cast("double")).otherwise(1.0)
    return per.select("source", "bytes", rate.alias("rate"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", seed: int = 42,
                weights: Mapping[str | None, float] | None = None,
                budget_bytes: int | None = None, copy_col: str = "copy",
                key_col: str = "mix_key") -> DataFrame:
    """``docs``, every row as often as drawn (perhaps never), with ``copy`` (from 0) and the
    shuffle key ``mix_key``, in shuffled order.

    Defined cases: a null source is a source of its own; a source without bytes, and every
    source if all weights are 0, keeps its documents at rate 1. Rows that share an id (or
    have none) draw the same number of copies. Null and empty texts count 0 bytes and are
    replicated like others. Other columns are passed through; the two new ones are named by
    the caller and must not exist. An empty table gives an empty result.
    """
    for c in (copy_col, key_col):
        if c in docs.columns:
            raise ValueError(f"column {c!r} exists already")
    rates = source_rates(docs, source_col, text_col, weights, budget_bytes)
    src, parts, table, n = (fresh(docs, c) for c in ("_source", "_parts", "_table", "_n"))
    many = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias(src), many.alias(parts),
                         poisson_table(F.col("rate") / many).alias(table))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.join(rates, F.col(source_col).eqNullSafe(F.col(src)), "inner")
    doc = F.col(id_col)

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), doc, part)
        return F.size(F.filter(F.col(table), lambda c: c <= u))

    first = uniform(F.lit(seed), doc)
    one = F.size(F.filter(F.col(table), lambda c: c <= first))
    some = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts)), draw), F.lit(0),
                       lambda a, b: a + b)
    rated = rated.withColumn(n, F.when(F.col(parts) == 1, one).otherwise(some))
    copies = rated.filter(F.col(n) > 0).select(
        *[F.col(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_col))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("null")),
                            F.col(copy_col).cast("string")))
    return copies.withColumn(key_col, key).repartition(F.col(key_col)).sortWithinPartitions(key_col)


def mix_oracle_sql(seed: int = 42) -> str:
    """The same draw in ANSI-style SQL (square-root weights, every rate under ``PART``)."""
    return f"""
WITH RECURSIVE per AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN
      CAST((SELECT sum(bytes) FROM per) AS DOUBLE) * sqrt(CAST(bytes AS DOUBLE))
      / (SELECT sum(sqrt(CAST(bytes AS DOUBLE))) FROM per) / CAST(bytes AS DOUBLE)
    ELSE 1.0 END AS rate FROM per),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT d.doc_id, d.source, d.text,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u FROM documents d),
counted AS (
  SELECT doc_id, source, text, (SELECT count(*) FROM cdf
      WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND cdf.c <= drawn.u) AS n FROM drawn),
copies AS (SELECT doc_id, source, text, unnest(range(n)) AS copy FROM counted)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, source,
  md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)) AS mix_key,
  text FROM copies"""
