"""Registered queries, steps 8-9: run logs, schedules, parameter statistics, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.constants import (CHECKPOINT_TEMPLATE, EMBEDDING_PARAM_MARKER,
                               SIGNIFICANT_PARAM_SUFFIXES, SUBMODULE_PREFIX)
from seqlake.functions.names import LOWER_KEYWORDS, sanitize_name
from seqlake.operators import runlog as RL
from seqlake.plans.fixtures import (PARAM_NAMES, batch_log, parameter_dump, round6, step_log,
                                    table)
from seqlake.plans.registry import query

INTERVAL = "1 hour"
TOTAL_BATCHES = 100_000
LR = 1e-3
SCHED_INTERVAL, ACCUMULATE, LOG_LO, LOG_EVERY = 10, 4, 1.0, 100

BLOG = r"""blog AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS batch_idx, CAST(round(value) AS BIGINT) AS n_tokens,
         user_id % 4 AS device, CAST(round(value) AS BIGINT) % 101 AS core_util,
         CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS mem_util
  FROM events)"""

SLOG = """slog AS (SELECT event_type AS run, event_id AS batch_idx, CAST(event_id // 4 AS BIGINT) AS step,
                   value AS loss FROM events)"""

MAXSTEP = f"mx AS (SELECT CAST(ceil(count(*) / {ACCUMULATE}) AS BIGINT) AS m FROM events)"
LIN = f"lin AS (SELECT CAST(unnest(range({SCHED_INTERVAL}, m, {SCHED_INTERVAL})) AS BIGINT) AS step FROM mx)"
LOG = f"""p AS (SELECT m, log10(m - 1) AS hi, CAST(floor(m / {LOG_EVERY}) AS INTEGER) AS num
      FROM mx WHERE m > 1),
xs AS (SELECT m, hi, num, unnest(range(0, num)) AS i FROM p WHERE num > 0),
logs AS (SELECT DISTINCT CASE WHEN num > 1 AND i = num - 1 THEN m - 1 ELSE CAST(floor(pow(10.0,
                  CASE WHEN num = 1 THEN CAST('{LOG_LO}' AS DOUBLE)
                  ELSE CAST('{LOG_LO}' AS DOUBLE) + i * ((hi - CAST('{LOG_LO}' AS DOUBLE)) / (num - 1)) END))
                  AS BIGINT) END AS step FROM xs)"""

_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in PARAM_NAMES) + "]"
_RE = r"^(?:[^.]*\.)*?layers\.([^.]*)(?:\.(.*))?$"


def _label_sql(col: str) -> str:
    sig = " OR ".join(f"ends_with({col}, '{s}')" for s in SIGNIFICANT_PARAM_SUFFIXES)
    layer = f"regexp_extract({col}, '{_RE}', 1)"
    rest = f"replace(regexp_extract({col}, '{_RE}', 2), '{SUBMODULE_PREFIX}', '')"
    return (f"CASE WHEN ({sig}) THEN CASE WHEN regexp_matches({col}, '(^|\\.)layers\\.') "
            f"AND regexp_matches({layer}, '^[+-]?[0-9]+$') THEN 'diag/L' || "
            f"CAST(CAST({layer} AS BIGINT) AS VARCHAR) || '/' || {rest} END "
            f"WHEN contains({col}, '{EMBEDDING_PARAM_MARKER}') THEN 'diag/embed' END")


def _label(col):
    return RL.parameter_label(col, SIGNIFICANT_PARAM_SUFFIXES, EMBEDDING_PARAM_MARKER,
                              SUBMODULE_PREFIX)


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


# ---------------------------------------------------------------- F21, F22

@query("throughput", f"""
WITH {BLOG},
per AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_batches,
               CAST(sum(n_tokens) AS BIGINT) AS tokens FROM blog GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n_batches, tokens,
       round(CAST(tokens AS DOUBLE) / 3600.0, 6) AS tokens_per_sec,
       round(CAST(sum(n_batches) OVER (ORDER BY window_start) AS DOUBLE) / {TOTAL_BATCHES} * 100.0, 6)
         AS percent_done
FROM per
""")
def q_throughput(spark, sf):
    t = RL.throughput(batch_log(spark, sf), INTERVAL, TOTAL_BATCHES)
    return round6(t.select(_ntz("window_start"), _ntz("window_end"), "n_batches", "tokens",
                           "tokens_per_sec", "percent_done"))


@query("throughput_total", f"""
WITH {BLOG},
t AS (SELECT count(*) AS n_batches, CAST(sum(n_tokens) AS BIGINT) AS tokens,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_sec FROM blog)
SELECT n_batches, tokens, round(elapsed_sec, 6) AS elapsed_sec,
       round(tokens / elapsed_sec, 6) AS avg_tokens_per_sec,
       round(CAST(n_batches AS DOUBLE) / {TOTAL_BATCHES} * 100.0, 6) AS percent_done FROM t
""")
def q_throughput_total(spark, sf):
    return round6(RL.throughput_total(batch_log(spark, sf), TOTAL_BATCHES))


@query("device_utilisation", f"""
WITH {BLOG}
SELECT date_trunc('hour', ts) AS window_start, device, round(avg(core_util), 6) AS avg_core_util,
       round(avg(mem_util), 6) AS avg_mem_util, count(*) AS n_samples
FROM blog GROUP BY 1, 2
""")
def q_device_utilisation(spark, sf):
    d = RL.device_utilisation(batch_log(spark, sf), INTERVAL)
    return round6(d.select(_ntz("window_start"), "device", "avg_core_util", "avg_mem_util",
                           "n_samples"))


# ---------------------------------------------------------------- S4, F23

@query("parameter_label", f"""
WITH n AS (SELECT DISTINCT {_NAMES_SQL}[label + 1] AS name FROM embeddings)
SELECT name, {_label_sql("name")} AS label FROM n
""")
def q_parameter_label(spark, sf):
    names = parameter_dump(spark, sf).select("name").distinct()
    return names.select("name", _label(F.col("name")).alias("label"))


@query("parameter_stats", f"""
WITH dump AS (
  SELECT vec_id // 50 AS step, {_NAMES_SQL}[label + 1] AS name, CAST(embedding[i] AS DOUBLE) AS value,
         CASE WHEN label = 9 THEN NULL ELSE CAST(embedding[i + 32] AS DOUBLE) END AS grad
  FROM embeddings, range(1, 33) r(i)),
st AS (SELECT step, name, count(*) FILTER (WHERE grad IS NULL) AS nulls,
              sqrt(sum(grad * grad)) AS grad_norm, sqrt(sum(value * value)) AS weight_norm,
              stddev_samp(value) AS sw, stddev_samp(grad) AS sg FROM dump GROUP BY step, name)
SELECT step, {_label_sql("name")} AS label, round(grad_norm, 6) AS grad_norm,
       round(weight_norm, 6) AS weight_norm,
       round(CASE WHEN sw > 0 THEN CAST('{LR}' AS DOUBLE) * sg / (sw + CAST('1e-08' AS DOUBLE))
                  ELSE 0.0 END, 6) AS update_ratio
FROM st WHERE nulls = 0 AND ({_label_sql("name")}) IS NOT NULL
""")
def q_parameter_stats(spark, sf):
    st = RL.parameter_stats(parameter_dump(spark, sf), LR)
    st = st.withColumn("label", _label(F.col("name"))).filter(F.col("label").isNotNull())
    return round6(st.select("step", "label", "grad_norm", "weight_norm", "update_ratio"))


# ---------------------------------------------------------------- G2, G3, G5, C5, G1, G4, S3

def _lin(spark, sf):
    return RL.schedule_linear(step_log(spark, sf), SCHED_INTERVAL, ACCUMULATE)


def _log(spark, sf):
    return RL.schedule_log(step_log(spark, sf), LOG_LO, ACCUMULATE, every=LOG_EVERY)


@query("schedule_linear", f"WITH {MAXSTEP}, {LIN} SELECT step FROM lin")
def q_schedule_linear(spark, sf):
    return _lin(spark, sf)


@query("schedule_log", f"WITH {MAXSTEP}, {LOG} SELECT step FROM logs")
def q_schedule_log(spark, sf):
    return _log(spark, sf)


@query("sorted_schedule", f"WITH {MAXSTEP}, {LOG} SELECT step, "
                          f"CAST(row_number() OVER (ORDER BY step) - 1 AS INTEGER) AS pos FROM logs")
def q_sorted_schedule(spark, sf):
    return RL.sorted_schedule(_log(spark, sf))


@query("schedule_semi", f"WITH {SLOG}, {MAXSTEP}, {LIN} "
                        f"SELECT * FROM slog WHERE step IN (SELECT step FROM lin)")
def q_schedule_semi(spark, sf):
    return RL.schedule_semi(step_log(spark, sf), _lin(spark, sf))


@query("first_per_step", f"""
WITH {MAXSTEP}, {LIN},
sl AS (SELECT 'all' AS run, event_id AS batch_idx, CAST(event_id // 4 AS BIGINT) AS step,
              value AS loss FROM events),
j AS (SELECT *, lag(step, 1, -1) OVER (PARTITION BY run ORDER BY batch_idx) AS prev FROM sl)
SELECT run, batch_idx, step, loss FROM j WHERE step > prev AND step IN (SELECT step FROM lin)
""")
def q_first_per_step(spark, sf):
    sl = step_log(spark, sf, one_run=True)
    return RL.first_per_step(sl, _lin(spark, sf)).select("run", "batch_idx", "step", "loss")


@query("first_per_step_gaps", f"""
WITH {MAXSTEP}, {LIN},
sl AS (SELECT event_type AS run, event_id AS batch_idx, CAST(event_id // 4 AS BIGINT) AS step,
              value AS loss FROM events WHERE event_id % 5 <> 2),
j AS (SELECT *, lag(step, 1, -1) OVER (PARTITION BY run ORDER BY batch_idx) AS prev FROM sl)
SELECT run, batch_idx, step, loss FROM j WHERE step > prev AND step IN (SELECT step FROM lin)
""")
def q_first_per_step_gaps(spark, sf):
    """G1 on counters with gaps: a run per event type, every fifth batch missing."""
    sl = step_log(spark, sf).filter("batch_idx % 5 <> 2")
    return RL.first_per_step(sl, _lin(spark, sf)).select("run", "batch_idx", "step", "loss")


BEST = f"""{SLOG},
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY loss, step, batch_idx) AS INTEGER)
               AS rank, 'top' AS kind FROM slog QUALIFY rank <= 3),
last AS (SELECT *, CAST(NULL AS INTEGER) AS rank, 'last' AS kind FROM slog
         QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC, batch_idx DESC) = 1),
best AS (SELECT * FROM top UNION ALL SELECT * FROM last)"""


@query("best_checkpoints", f"WITH {BEST} SELECT run, batch_idx, step, loss, rank, kind FROM best")
def q_best_checkpoints(spark, sf):
    return RL.best_checkpoints(step_log(spark, sf), 3).select(
        "run", "batch_idx", "step", "loss", "rank", "kind")


_SQL_TEMPLATE = CHECKPOINT_TEMPLATE.replace("'", "''")


@query("checkpoint_name", f"WITH {BEST} SELECT run, kind, "
                          f"printf('{_SQL_TEMPLATE}', step // 500, loss, step) AS name FROM best")
def q_checkpoint_name(spark, sf):
    b = RL.best_checkpoints(step_log(spark, sf), 3)
    name = RL.checkpoint_name(F.floor(F.col("step") / 500).cast("bigint"), F.col("loss"),
                              F.col("step"), CHECKPOINT_TEMPLATE)
    return b.select("run", "kind", name.alias("name"))


# ---------------------------------------------------------------- S2, S5, S1

@query("run_name", """
SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y%m%d_%H%M') ||
       CASE WHEN event_type = 'view' THEN '' ELSE '_' || event_type END AS run_name
FROM events
""")
def q_run_name(spark, sf):
    e = table(spark, sf, "events")
    suffix = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    return e.select("event_id", RL.run_name(F.col("ts").cast("timestamp"), suffix).alias("run_name"))


@query("metric_name", "SELECT DISTINCT event_type AS run, concat_ws('/', 'train', event_type, 'loss', "
                      "'total') AS metric FROM events")
def q_metric_name(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("run")).distinct()
    return runs.select("run", RL.metric_name(F.lit("train"), "run", F.lit("loss"),
                                             F.lit("total")).alias("metric"))


EXTRA_NAMES = ("9abc", "class", "/x/y/", "gs://a/b.ckpt", "---")
_KW = ", ".join(f"'{k}'" for k in LOWER_KEYWORDS)


def _sanitize_sql(col: str) -> tuple[str, str]:
    loose = f"regexp_replace(regexp_replace(lower({col}), '[^0-9a-z]+', '_', 'g'), '_+$', '')"
    s1 = f"(CASE WHEN regexp_matches({loose}, '^[0-9]') THEN '_' || {loose} ELSE {loose} END)"
    s2 = f"(CASE WHEN {s1} IN ({_KW}) THEN '_' || {s1} ELSE {s1} END)"
    s3 = f"(CASE WHEN starts_with({s2}, '_') THEN 'f' || {s2} ELSE {s2} END)"
    return (f"CASE WHEN length({loose}) = 0 THEN NULL ELSE {s3} END",
            f"CASE WHEN length({loose}) = 0 THEN NULL ELSE {loose} END")


_EXTRA_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name" for n in EXTRA_NAMES)


@query("sanitize_name", f"""
WITH n AS (SELECT url AS name FROM pages UNION ALL {_EXTRA_SQL})
SELECT name, {_sanitize_sql("name")[0]} AS strict_name, {_sanitize_sql("name")[1]} AS loose_name FROM n
""")
def q_sanitize_name(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("url").alias("name"))
    extra = spark.createDataFrame([(n,) for n in EXTRA_NAMES], "name string")
    n = pages.unionByName(extra)
    return n.select("name", sanitize_name(F.col("name"), strict=True).alias("strict_name"),
                    sanitize_name(F.col("name"), strict=False).alias("loose_name"))


@query("first_per_step_validation", f"""
WITH {MAXSTEP}, {LIN},
sl AS (SELECT 'all' AS run, event_id AS batch_idx, CAST(event_id // 4 AS BIGINT) AS step,
              value AS loss FROM events),
j AS (SELECT *, lag(step - 1, 1, -1) OVER (PARTITION BY run ORDER BY batch_idx) AS prev FROM sl)
SELECT run, batch_idx, step, loss FROM j
WHERE step - 1 > prev AND step - 1 IN (SELECT step FROM lin)
""")
def q_first_per_step_validation(spark, sf):
    """G1, validation variant: the hook sees ``global_step - 1``."""
    sl = step_log(spark, sf, one_run=True)
    return RL.first_per_step(sl, _lin(spark, sf), offset=-1).select("run", "batch_idx", "step", "loss")
