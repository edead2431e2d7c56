"""Registered queries, steps 5 and 10: scoring, stores, probes, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators import labels as LB
from seqlake.operators import probes as PR
from seqlake.plans.fixtures import (batch_log, derived_path, probe_features, round6, table)
from seqlake.plans.q_probe import _results_sql
from seqlake.plans.registry import query
from seqlake.session import scratch_path
from seqlake.sources import delta_store as DS
from seqlake.sources import stores as ST
from seqlake.streaming.soft_labels import run_soft_label_stream
from seqlake.streaming.throughput import file_stream, late_rows, run_to_parquet, throughput_stream

# Linear scorer of the fixtures: weight of element i (1-based) is ((i % 7) - 3) / 10.
WEIGHTS = [((i % 7) - 3) / 10 for i in range(1, 65)]
SCORE_SQL = ("list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * "
             "(CAST((i % 7) - 3 AS DOUBLE) / 10.0)))")
STORE_BATCH = 50


def _scored(df):
    return PR.score_batches(df, PR.linear_scorer(WEIGHTS), "embedding", 64, "score")


@query("score_batches", f"SELECT vec_id, round({SCORE_SQL}, 6) AS score FROM embeddings")
def q_score_batches(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return round6(_scored(e).select("vec_id", "score"))


@query("append_soft_labels", f"SELECT vec_id AS sample, vec_id // {STORE_BATCH} AS batch_idx, "
                             f"round({SCORE_SQL}, 6) AS score FROM embeddings")
def q_append_soft_labels(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "embedding")
    scored = _scored(e).select("sample", (F.col("sample") / STORE_BATCH).cast("bigint")
                               .alias("batch_idx"), "score")
    store = scratch_path(spark, "soft-labels")
    # an interrupted first run (odd samples only), then the full run over the same batches
    DS.append_soft_labels(scored.filter(F.col("sample") % 2 == 1), store, ["sample"])
    DS.append_soft_labels(scored, store, ["sample"])
    DS.append_soft_labels(scored.filter(F.col("batch_idx") < 3), store, ["sample"])
    return round6(DS.read_soft_labels(spark, store, ["sample"]).select("sample", "batch_idx", "score"))


BLOCKS, BLOCK_LEN = 3, 16      # blocks per sample, values per block
_BLOCK_KEY = ["sample", "block"]


def _blocks(e, run: str):
    """Rows per (sample, block): its values times the number of the run that wrote them."""
    b = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    rows = e.select(F.col("vec_id").alias("sample"), "embedding", b)
    return rows.select("sample", "block", F.expr(run).alias("run"), F.transform(
        F.slice("embedding", F.col("block") * BLOCK_LEN + 1, BLOCK_LEN), lambda x: x.cast("double")).alias("logits"))


def _blocks_sql(run: str) -> str:
    return f"""
SELECT vec_id AS sample, CAST(b AS INTEGER) AS block, CAST({run} AS INTEGER) AS run, round(list_sum(list_transform(
    range(b * {BLOCK_LEN} + 1, (b + 1) * {BLOCK_LEN} + 1), lambda i: CAST(embedding[i] AS DOUBLE))), 6) AS total
FROM embeddings, range(0, {BLOCKS}) r(b)"""


def _block_totals(rows):
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + x)
    return round6(rows.select("sample", "block", "run", total.alias("total")))


@query("append_blocks", _blocks_sql("CASE WHEN vec_id % 5 = 0 THEN 2 WHEN b = 1 THEN 3 ELSE 1 END"))
def q_append_blocks(spark, sf):
    """A4 with several rows per sample: a full run, a rerun of it under its own name (nothing
    happens), block 1 written anew, a compaction, and every fifth sample written anew."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    store = scratch_path(spark, "blocks")
    for _ in range(2):
        DS.append_soft_labels(_blocks(e, "1"), store, _BLOCK_KEY, commit="first run")
    DS.append_soft_labels(_blocks(e, "3").filter("block = 1"), store, _BLOCK_KEY)
    DS.compact(spark, store, _BLOCK_KEY)
    DS.append_soft_labels(_blocks(e, "2").filter("sample % 5 = 0"), store, _BLOCK_KEY)
    return _block_totals(DS.read_soft_labels(spark, store, _BLOCK_KEY))


@query("stream_blocks", _blocks_sql("1"))
def q_stream_blocks(spark, sf):
    """T2 with several rows per sample."""
    src, store = scratch_path(spark, "blocks-in"), scratch_path(spark, "blocks-store")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    e.repartition(4, F.col("vec_id") % 4).write.parquet(src)
    stream = file_stream(spark, src, e.schema, lambda df: _blocks(df, "1"))
    run_soft_label_stream(stream, store, scratch_path(spark, "blocks-ckpt"), _BLOCK_KEY)
    return _block_totals(DS.read_soft_labels(spark, store, _BLOCK_KEY))


@query("read_through", """
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(max(CAST(embedding[p * 8 + d + 1] AS DOUBLE)), 6) AS value
FROM embeddings, range(0, 8) pp(p), range(0, 8) dd(d) GROUP BY vec_id, d
""")
def q_read_through(spark, sf):
    params = {"model": "max_pool", "rows": 8, "cols": 8}
    path = derived_path(spark, sf, "features", ("embeddings",), **params)

    def build():
        e = table(spark, sf, "embeddings")
        states = LB.reshape(F.transform("embedding", lambda x: x.cast("double")), 8, 8)
        pooled = e.select("vec_id", LB.max_pool(states).alias("pooled"))
        return pooled.select("vec_id", F.posexplode("pooled").alias("dim", "value"))

    ST.read_through(spark, path, build)          # builds on first use
    return round6(ST.read_through(spark, path, build))   # then only reads


@query("probe_lreg")
def q_probe_lreg(spark, sf):
    f = probe_features(spark, sf)
    model = PR.probe_lreg(f.filter(F.col("split") == "train"), seed=0)
    return round6(PR.predict(model, f).select("sample_id", "split", "label", "score", "pred"))


@query("probe_gbrt")
def q_probe_gbrt(spark, sf):
    f = probe_features(spark, sf)
    model = PR.probe_gbrt(f.filter(F.col("split") == "train"), seed=0)
    return round6(PR.predict(model, f).select("sample_id", "split", "label", "score", "pred"))


@query("run_probes")
def q_run_probes(spark, sf):
    return round6(PR.run_probes(probe_features(spark, sf), seed=0))


def _centroid(train):
    """A probe in closed form, as a user would pass one: the nearer class mean. The means are two
    numbers per dimension."""
    means = {(r.label, r.i): r.m for r in train.select("label", F.posexplode("feature").alias("i", "v"))
             .groupBy("label", "i").agg(F.avg("v").alias("m")).collect()}
    dims = 1 + max(i for _, i in means)

    def apply(df):
        def far(label):
            mean = F.array(*[F.lit(means[label, i]) for i in range(dims)])
            return F.aggregate(F.zip_with("feature", mean, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)

        out = df.withColumn("score", far(0) - far(1))
        return out.withColumn("pred", (F.col("score") > 0).cast("int"))
    return apply


_CENTROID = """
feat AS (SELECT 'task' || CAST(label // 5 AS VARCHAR) AS task_name, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END
           AS split, vec_id AS sample_id, label % 2 AS label, embedding FROM embeddings),
x AS (SELECT task_name, split, sample_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM feat, range(1, 65) r(i)),
mean AS (SELECT task_name, label AS k, i, avg(v) AS m FROM x WHERE split = 'train' GROUP BY ALL),
far AS (SELECT task_name, split, sample_id, label, k, sum((v - m) * (v - m)) AS d FROM x JOIN mean USING (task_name, i)
        GROUP BY ALL),
sc AS (SELECT task_name, split, sample_id, label, sum(CASE k WHEN 0 THEN d ELSE -d END) AS score FROM far GROUP BY ALL),
scp AS (SELECT *, task_name AS lang, CAST(score > 0 AS INTEGER) AS pred FROM sc)"""


@query("score_probes", f"WITH {_CENTROID} SELECT task_name, 'centroid' AS model, split, sample_id, label, "
                       f"round(score, 6) AS score, pred FROM scp")
def q_score_probes(spark, sf):
    """H4 up to the score table, with a probe that SQL can fit, too."""
    return round6(PR.score_probes(probe_features(spark, sf), scratch_path(spark, "scores"), {"centroid": _centroid}))


@query("probe_results", f"WITH {_CENTROID}, {_results_sql('scp', 'centroid')} "
                        f"SELECT task_name, model, split, metric, round(value, 6) AS value FROM res")
def q_probe_results(spark, sf):
    """H4, the six metrics of that probe from its score table."""
    return round6(PR.probe_results(PR.score_probes(probe_features(spark, sf), scratch_path(spark, "scores"),
                                                   {"centroid": _centroid})))


@query("probe_score_checks", """
SELECT 'task' || CAST(label // 5 AS VARCHAR) AS task_name, m.model, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END
    AS split, count(*) AS n, count(*) AS n_probabilities, count(*) AS n_decided_by_score,
  count(*) FILTER (WHERE label % 2 = 1) AS n_positive
FROM embeddings, (SELECT unnest(['gbrt', 'lreg']) AS model) m GROUP BY ALL""")
def q_probe_score_checks(spark, sf):
    """H2, H3 and H4 with the fitted models, as far as SQL can follow: every sample is scored once
    by either, with a probability that decides its prediction."""
    scores = PR.score_probes(probe_features(spark, sf), scratch_path(spark, "scores"), PR.standard_fitters(seed=0))
    return scores.groupBy("task_name", "model", "split").agg(
        F.count("*").alias("n"), F.count_if(F.col("score").between(0, 1)).alias("n_probabilities"),
        F.count_if((F.col("score") > 0.5) == (F.col("pred") == 1)).alias("n_decided_by_score"),
        F.count_if(F.col("label") == 1).alias("n_positive"))


@query("stream_throughput", r"""
WITH blog AS (SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(round(value) AS BIGINT) AS n_tokens FROM events),
per AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_batches,
               CAST(sum(n_tokens) AS BIGINT) AS tokens FROM blog GROUP BY 1)
SELECT window_start, n_batches, tokens, round(CAST(tokens AS DOUBLE) / 3600.0, 6) AS tokens_per_sec
FROM per
""")
def q_stream_throughput(spark, sf):
    src = scratch_path(spark, "batch-log-in")
    log = batch_log(spark, sf)
    log.repartition(4, "device").write.parquet(src)
    stream = file_stream(spark, src, log.schema, lambda df: throughput_stream(df, "1 hour", "2 hours"))
    sink = scratch_path(spark, "throughput-out")
    run_to_parquet(stream, sink, scratch_path(spark, "throughput-ckpt"), mode="complete")
    out = spark.read.parquet(sink)
    return round6(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                             "n_batches", "tokens", "tokens_per_sec"))


# Rows of the first half that come when the watermark is past them; and those that move it there.
_LATE = "event_id % 10 = 7 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"
_PER = f"""
WITH b AS (SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(round(value) AS BIGINT) AS n_tokens, {_LATE} AS late FROM events),
per AS (SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (WHERE NOT late) AS n_batches,
          CAST(sum(n_tokens) FILTER (WHERE NOT late) AS BIGINT) AS tokens, count(*) FILTER (WHERE late) AS n_late
        FROM b GROUP BY 1),
closed AS (SELECT * FROM per
           WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FILTER (WHERE NOT late) FROM b) - INTERVAL 2 HOUR)"""


def _run_append(spark, sf):
    """The log with its late rows in three deliveries, each a run of the same stream: all that
    is in time, a second delivery that sees the moved watermark, the late rows."""
    log = batch_log(spark, sf).select("ts", "batch_idx", "n_tokens")
    ends = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    late = (F.col("batch_idx") % 10 == 7) & (F.col("ts") < F.lit(ends.a + (ends.b - ends.a) / 2))
    second = F.col("ts") > F.lit(ends.b) - F.expr("INTERVAL 1 HOUR")
    src, sink, ckpt = (scratch_path(spark, f"append-{x}") for x in ("in", "out", "ckpt"))
    for part in (~late & ~second, ~late & second, late):
        log.filter(part).write.mode("append").parquet(src)
        stream = file_stream(spark, src, log.schema, lambda df: throughput_stream(df, "1 hour", "2 hours"),
                             max_files=1_000_000)
        run_to_parquet(stream, sink, ckpt, mode="append")
    return spark.read.parquet(src), spark.read.parquet(sink)


@query("stream_throughput_append", _PER + """
SELECT window_start, n_batches, tokens, round(CAST(tokens AS DOUBLE) / 3600.0, 6) AS tokens_per_sec
FROM closed WHERE n_batches > 0""")
def q_stream_throughput_append(spark, sf):
    """T1 in append mode: windows come out once, when the watermark has passed them."""
    _, out = _run_append(spark, sf)
    return round6(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                             "n_batches", "tokens", "tokens_per_sec"))


@query("stream_late_rows", _PER + """
SELECT window_start, n_batches + n_late AS n_logged, n_batches AS n_counted, n_late FROM closed WHERE n_late > 0""")
def q_stream_late_rows(spark, sf):
    """T1, the report of rows that came behind the watermark."""
    log, out = _run_append(spark, sf)
    rep = late_rows(log, out, "1 hour")
    return rep.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_logged", "n_counted",
                      "n_late")


@query("stream_soft_labels", f"SELECT vec_id AS sample, vec_id // {STORE_BATCH} AS batch_idx, "
                             f"round({SCORE_SQL}, 6) AS score FROM embeddings")
def q_stream_soft_labels(spark, sf):
    src = scratch_path(spark, "embeddings-in")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "embedding")
    # four files, each holding a quarter of every batch: batches span micro-batches
    e.repartition(4, F.col("sample") % 4).write.parquet(src)
    stream = file_stream(spark, src, e.schema, lambda df: _scored(df).select(
        "sample", (F.col("sample") / STORE_BATCH).cast("bigint").alias("batch_idx"), "score"))
    store = scratch_path(spark, "soft-label-store")
    run_soft_label_stream(stream, store, scratch_path(spark, "soft-label-ckpt"), ["sample"])
    return round6(DS.read_soft_labels(spark, store, ["sample"]).select("sample", "batch_idx", "score"))
