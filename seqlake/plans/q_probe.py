"""Registered queries, steps 6-7: tasks, label profiling, metrics, result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.operators import indexing as IX
from seqlake.operators import labels as LB
from seqlake.operators import metrics as M
from seqlake.plans.fixtures import (TASK_ORDER, derived_path, labelled_task, probe_features,
                                    round6, scored_documents, table)
from seqlake.plans.registry import query
from seqlake.session import scratch_path
from seqlake.sources import stores as ST
from seqlake.sources.tasks import task_scan, write_tasks

TASK = """task AS (
  SELECT task_name, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         doc_id AS sample_id, text AS sequence, label
  FROM (UNPIVOT labels ON quality, toxic INTO NAME task_name VALUE label) u
  JOIN documents USING (doc_id))"""

SCORED = """sc AS (
  SELECT doc_id, lang, n_chars // 500 AS score, quality AS label,
         CAST(n_chars // 500 >= 5 AS INTEGER) AS pred,
         CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM labels JOIN documents USING (doc_id))"""

FEAT = """feat AS (
  SELECT 'task' || CAST(label // 5 AS VARCHAR) AS task_name,
         CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         vec_id AS sample_id, label % 2 AS label
  FROM embeddings)"""


def _auc_sql(src: str, by: str, sfx: str = "") -> str:
    """Oracle AUC by the rank-sum (Mann-Whitney) formula with average ranks for ties --
    a different formula from the Spark operator. CTE names end in ``sfx``."""
    return f"""
r{sfx} AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score)
             + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS avg_rank FROM {src}),
a{sfx} AS (SELECT {by}, sum(avg_rank) FILTER (WHERE label > 0) AS rpos,
             count(*) FILTER (WHERE label > 0) AS p, count(*) FILTER (WHERE label <= 0) AS n
      FROM r{sfx} GROUP BY {by}),
auc{sfx} AS (SELECT {by}, CASE WHEN p > 0 AND n > 0 THEN (rpos - p * (p + 1) / 2.0) / (p * n)
                          ELSE CAST('nan' AS DOUBLE) END AS roc_auc FROM a{sfx})"""


def _cls_sql(src: str, by: str, sfx: str = "") -> str:
    return f"""
cm{sfx} AS (SELECT {by},
         CAST(count(*) FILTER (WHERE label > 0 AND pred > 0) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE label <= 0 AND pred > 0) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE label <= 0 AND pred <= 0) AS DOUBLE) AS tn,
         CAST(count(*) FILTER (WHERE label > 0 AND pred <= 0) AS DOUBLE) AS fn,
         count(*) AS n_samples, count(*) FILTER (WHERE label > 0) AS n_positive
       FROM {src} GROUP BY {by}),
cls{sfx} AS (SELECT {by},
         CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
              ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc,
         (tp + tn) / n_samples AS accuracy,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
         n_samples, n_positive FROM cm{sfx})"""


def _results_sql(src: str, model: str, sfx: str = "") -> str:
    """Long results of ``src`` (needs lang as the task, split) for one model name; the
    final CTE is ``res{sfx}``."""
    return f"""
{_auc_sql(src, "lang, split", sfx)},
{_cls_sql(src, "lang, split", sfx)},
wide{sfx} AS (SELECT auc{sfx}.lang AS task_name, '{model}' AS model, auc{sfx}.split,
                auc{sfx}.roc_auc, cls{sfx}.mcc, cls{sfx}.accuracy, cls{sfx}.f1,
                CAST(cls{sfx}.n_samples AS DOUBLE) AS n_samples,
                CAST(cls{sfx}.n_positive AS DOUBLE) AS n_positive
         FROM auc{sfx} JOIN cls{sfx} USING (lang, split)),
res{sfx} AS (UNPIVOT wide{sfx} ON roc_auc, mcc, accuracy, f1, n_samples, n_positive
        INTO NAME metric VALUE value)"""


# ---------------------------------------------------------------- Spark helpers

def _task_path(spark, sf):
    path = derived_path(spark, sf, "tasks", ("documents", "labels"))
    if not ST.is_done(spark, path):
        write_tasks(labelled_task(spark, sf), path)
        ST.mark_done(spark, path)
    return path


def _tasks(spark, sf):
    return task_scan(spark, _task_path(spark, sf))


def _results(spark, sf, model="length", score_col="score"):
    s = scored_documents(spark, sf).withColumnRenamed("lang", "task_name")
    if score_col != "score":
        s = s.withColumn("score", F.col(score_col))
    wide = M.evaluate(s, ["task_name", "split"]).withColumn("model", F.lit(model))
    return M.results_long(wide)


# ---------------------------------------------------------------- A3, B9, B12, D6, E5

@query("task_scan", f"WITH {TASK} SELECT task_name, split, sample_id, sequence, label FROM task")
def q_task_scan(spark, sf):
    # every task, both splits (a task list prunes partitions: see task_group)
    return task_scan(spark, _task_path(spark, sf), splits=("train", "test")).select(
        "task_name", "split", "sample_id", "sequence", "label")


GROUPS = {"text_labels": list(TASK_ORDER)}


@query("task_group", f"WITH {TASK} SELECT task_name, split, sample_id, label FROM task "
                     f"WHERE task_name = 'quality'")
def q_task_group(spark, sf):
    dim = LB.task_groups(spark, GROUPS)
    return LB.task_group(_tasks(spark, sf), dim, "text_labels", limit=1).select(
        "task_name", "split", "sample_id", "label")


@query("assign", "SELECT vec_id AS sample_id, 'emb' AS task_name, 'probe' AS model, label "
                 "FROM embeddings")
def q_assign(spark, sf):
    e = table(spark, sf, "embeddings")
    return LB.assign(e.select(F.col("vec_id").alias("sample_id"), "label"),
                     task_name="emb", model="probe").select("sample_id", "task_name", "model", "label")


@query("feature_concat", f"WITH {FEAT} SELECT task_name, split, sample_id, label FROM feat")
def q_feature_concat(spark, sf):
    f = probe_features(spark, sf)
    parts = []
    for t in ("task0", "task1"):
        for s in ("train", "test"):
            part = f.filter((F.col("task_name") == t) & (F.col("split") == s))
            parts.append(LB.assign(part.select("sample_id", "label"), task_name=t, split=s))
    return LB.feature_concat(parts).select("task_name", "split", "sample_id", "label")


@query("max_pool", """
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(max(CAST(embedding[p * 8 + d + 1] AS DOUBLE)), 6) AS value
FROM embeddings, range(0, 8) pp(p), range(0, 8) dd(d) GROUP BY vec_id, d
""")
def q_max_pool(spark, sf):
    e = table(spark, sf, "embeddings")
    states = LB.reshape(F.transform("embedding", lambda x: x.cast("double")), 8, 8)
    pooled = e.select("vec_id", LB.max_pool(states).alias("pooled"))
    return round6(pooled.select("vec_id", F.posexplode("pooled").alias("dim", "value")))


POOL_ROWS = 3      # positions per stored block, the last block of a sample is short


@query("max_pool_blocks", """
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(max(CAST(embedding[p * 8 + d + 1] AS DOUBLE)), 6) AS value
FROM embeddings, range(0, 8) pp(p), range(0, 8) dd(d) GROUP BY vec_id, d
""")
def q_max_pool_blocks(spark, sf):
    """E5 from blocks of positions, as M6 stores them."""
    e = table(spark, sf, "embeddings")
    b = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7 // POOL_ROWS))).alias("block"))
    states = F.transform(F.slice("embedding", F.col("block") * (8 * POOL_ROWS) + 1, 8 * POOL_ROWS),
                         lambda x: x.cast("double"))
    return round6(LB.max_pool_blocks(b.select("vec_id", "block", states.alias("states")), ["vec_id"], 8))


# Stand-in feature sets of five tasks (label % 5), of which the featuriser cannot make some
# samples: task 3 where the first number is over 0.3, and task 4 has no test split.
_TASK5, _ERR = "'task' || CAST(label % 5 AS VARCHAR)", "label % 5 = 3 AND embedding[1] > 0.3"
OUTCOME = f"""f AS (
  SELECT {_TASK5} AS task_name, CASE WHEN vec_id % 5 = 0 AND label % 5 <> 4 THEN 'test' ELSE 'train' END AS split,
         vec_id AS sample_id, label % 2 AS label, CASE WHEN {_ERR} THEN 'out of range' END AS error FROM embeddings),
t AS (SELECT 'task' || CAST(i AS VARCHAR) AS task_name FROM range(0, 7) r(i)),
o AS (
  SELECT task_name, count(sample_id) AS n_samples, count(error) AS n_failed, min(error) AS why,
    concat_ws(',', CASE WHEN count(*) FILTER (WHERE split = 'train') = 0 THEN 'train' END,
                   CASE WHEN count(*) FILTER (WHERE split = 'test') = 0 THEN 'test' END) AS missing
  FROM t LEFT JOIN f USING (task_name) GROUP BY task_name),
out AS (SELECT task_name, CASE WHEN n_failed > 0 THEN 'failed' WHEN missing <> '' THEN 'empty' ELSE 'ok' END AS status,
    n_samples, n_failed, CASE WHEN n_failed > 0 THEN why WHEN missing <> '' THEN missing END AS detail FROM o)"""


def _outcome_parts(spark, sf):
    e = table(spark, sf, "embeddings")
    task = F.concat(F.lit("task"), (F.col("label") % 5).cast("string"))
    split = F.when((F.col("vec_id") % 5 == 0) & (F.col("label") % 5 != 4), "test").otherwise("train")
    error = F.when((F.col("label") % 5 == 3) & (F.element_at("embedding", 1) > 0.3), "out of range")
    rows = e.select(task.alias("task_name"), split.alias("split"), F.col("vec_id").alias("sample_id"),
                    F.when(error.isNull(), F.col("embedding")).alias("feature"),
                    (F.col("label") % 2).alias("label"), error.alias("error"))
    listed = spark.createDataFrame([(f"task{i}",) for i in range(7)], "task_name string")
    return [rows.filter(F.col("split") == s) for s in ("train", "test")], listed


@query("task_outcomes", f"WITH {OUTCOME} SELECT * FROM out")
def q_task_outcomes(spark, sf):
    """Good, failed and empty tasks of a list."""
    return LB.concat_tasks(*_outcome_parts(spark, sf))[1]


@query("concat_tasks", f"WITH {OUTCOME} SELECT task_name, split, sample_id, label FROM f JOIN out USING (task_name) "
                       f"WHERE status = 'ok'")
def q_concat_tasks(spark, sf):
    """The features of the good tasks; a task that failed in one split goes as a whole."""
    return LB.concat_tasks(*_outcome_parts(spark, sf))[0].select("task_name", "split", "sample_id", "label")


# ---------------------------------------------------------------- F9-F14

@query("label_unique", f"WITH {TASK} SELECT task_name, split, "
                       f"array_to_string(list_sort(list_distinct(list(label))), ',') AS labels "
                       f"FROM task GROUP BY task_name, split")
def q_label_unique(spark, sf):
    u = LB.label_unique(_tasks(spark, sf))
    return u.select("task_name", "split", F.array_join("labels", ",").alias("labels"))


@query("label_types", f"WITH {TASK} SELECT task_name, split, CASE typeof(label) "
                      f"WHEN 'INTEGER' THEN 'int' ELSE lower(typeof(label)) END AS label_type, "
                      f"count(*) AS count FROM task GROUP BY ALL")
def q_label_types(spark, sf):
    return LB.label_types(_tasks(spark, sf))


@query("label_frequencies", f"WITH {TASK}, c AS (SELECT task_name, split, label, count(*) AS count "
                            f"FROM task GROUP BY ALL) SELECT *, round(count / sum(count) OVER "
                            f"(PARTITION BY task_name, split), 6) AS proportion FROM c")
def q_label_frequencies(spark, sf):
    return round6(LB.label_frequencies(_tasks(spark, sf)))


@query("label_null_check", f"WITH {TASK} SELECT task_name, split, "
                           f"count(*) FILTER (WHERE label IS NULL) AS n_null FROM task GROUP BY ALL")
def q_label_null_check(spark, sf):
    return LB.label_null_check(_tasks(spark, sf), strict=True)


@query("distinct_tasks", f"""
WITH {TASK},
o AS (SELECT task_name, row_number() OVER (ORDER BY CASE task_name WHEN 'quality' THEN 0 ELSE 1 END,
             CASE split WHEN 'train' THEN 0 ELSE 1 END, sample_id) - 1 AS sample_idx FROM task),
f AS (SELECT task_name, min(sample_idx) AS first_idx FROM o GROUP BY task_name)
SELECT task_name, first_idx, row_number() OVER (ORDER BY first_idx) - 1 AS task_pos FROM f
""")
def q_distinct_tasks(spark, sf):
    t = _tasks(spark, sf)
    order = [F.when(F.col("task_name") == "quality", 0).otherwise(1),
             F.when(F.col("split") == "train", 0).otherwise(1), F.col("sample_id")]
    # only the keys are indexed, never the sequences
    t = t.select("task_name", "sample_id", order[0].alias("_t"), order[1].alias("_s"))
    ix = IX.global_index(t, ["_t", "_s", "sample_id"], "sample_idx")
    return LB.distinct_tasks(ix).select("task_name", "first_idx",
                                        F.col("task_pos").cast("bigint").alias("task_pos"))


@query("label_gate", f"""
WITH {TASK}
SELECT task_name, count(*) AS n_samples,
       count(DISTINCT label) FILTER (WHERE split = 'train') AS n_train_labels,
       CASE WHEN count(DISTINCT label) FILTER (WHERE split = 'train') > 2 THEN 'error'
            WHEN count(DISTINCT label) FILTER (WHERE split = 'train') < 2 THEN 'skip'
            ELSE 'ok' END AS status
FROM task GROUP BY task_name
""")
def q_label_gate(spark, sf):
    return LB.label_gate(_tasks(spark, sf))


_GATE_SQL = """
n AS (SELECT task_name, count(sample_id) AS n_samples,
        count(DISTINCT label) FILTER (WHERE split = 'train') AS n_train_labels
      FROM listed LEFT JOIN src USING (task_name) GROUP BY task_name)
SELECT task_name, n_samples, n_train_labels,
  CASE WHEN n_samples = 0 OR n_samples = (SELECT sum(n_samples) FROM n) THEN 'error'
       WHEN n_train_labels > 2 THEN 'error' WHEN n_train_labels < 2 THEN 'skip' ELSE 'ok' END AS status FROM n
"""


def _listed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "task_name string")


@query("label_gate_listed", f"WITH {TASK}, src AS (SELECT * FROM task), listed AS (SELECT unnest("
                            f"['quality', 'toxic', 'absent']) AS task_name),{_GATE_SQL}")
def q_label_gate_listed(spark, sf):
    """F14 with a list: a task without samples is an error."""
    return LB.label_gate(_tasks(spark, sf), _listed(spark, "quality", "toxic", "absent"))


@query("label_gate_whole", f"WITH {TASK}, src AS (SELECT * FROM task WHERE task_name = 'quality'), listed AS "
                           f"(SELECT unnest(['quality', 'absent']) AS task_name),{_GATE_SQL}")
def q_label_gate_whole(spark, sf):
    """F14 with a list: of several tasks none may hold every sample."""
    only = _tasks(spark, sf).filter(F.col("task_name") == "quality")
    return LB.label_gate(only, _listed(spark, "quality", "absent"))


# ---------------------------------------------------------------- F15-F20, B8, C3, A6

@query("roc_auc", f"WITH {SCORED}, {_auc_sql('sc', 'lang')} "
                  f"SELECT lang, round(roc_auc, 6) AS roc_auc FROM auc")
def q_roc_auc(spark, sf):
    return round6(M.roc_auc(scored_documents(spark, sf), ["lang"]))


@query("roc_auc_null_group", f"WITH {SCORED}, scn AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN NULL "
                             f"ELSE lang END AS lang) FROM sc), {_auc_sql('scn', 'lang')} "
                             f"SELECT lang, round(roc_auc, 6) AS roc_auc FROM auc")
def q_roc_auc_null_group(spark, sf):
    """F15 with a NULL group key, the largest group at that."""
    d = scored_documents(spark, sf)
    return round6(M.roc_auc(d.withColumn("lang", F.nullif("lang", F.lit("en"))), ["lang"]))


@query("roc_auc_single_class", f"WITH {SCORED}, {_auc_sql('sc', 'lang, label')} "
                               f"SELECT lang, label, roc_auc FROM auc")
def q_roc_auc_single_class(spark, sf):
    return M.roc_auc(scored_documents(spark, sf), ["lang", "label"])


@query("classification_metrics", f"WITH {SCORED}, {_cls_sql('sc', 'lang')} "
                                 f"SELECT lang, round(mcc, 6) AS mcc, round(accuracy, 6) AS accuracy, "
                                 f"round(f1, 6) AS f1, n_samples, n_positive FROM cls")
def q_classification_metrics(spark, sf):
    return round6(M.classification_metrics(scored_documents(spark, sf), ["lang"]))


@query("results_long", f"WITH {SCORED}, {_results_sql('sc', 'length')} "
                       f"SELECT task_name, model, split, metric, round(value, 6) AS value FROM res")
def q_results_long(spark, sf):
    return round6(_results(spark, sf))


@query("headline_metrics", f"WITH {SCORED}, {_results_sql('sc', 'length')} "
                           f"SELECT 'nt_eval/' || task_name || '/' || metric AS name, model, "
                           f"round(value, 6) AS value FROM res "
                           f"WHERE split = 'test' AND metric IN ('roc_auc', 'f1')")
def q_headline_metrics(spark, sf):
    return round6(M.headline_metrics(_results(spark, sf)))


_CMP_SRC = """sc2 AS (SELECT doc_id, lang, (doc_id * 7919) % 1000 AS score, label, pred, split FROM sc),
sc3 AS (SELECT doc_id, lang, n_chars AS score, label, pred, split
        FROM sc JOIN documents USING (doc_id, lang))"""


def _cmp_sql() -> str:
    """Three result sets (random-like, experiment, teacher scores); the experiment lacks
    one key and the teacher has one duplicated."""
    return f"""
WITH {SCORED}, {_CMP_SRC},
{_results_sql("sc2", "probe", "_r").strip()},
{_results_sql("sc", "probe", "_e").strip()},
{_results_sql("sc3", "probe", "_t").strip()},
exp AS (SELECT * FROM res_e WHERE NOT (task_name = 'de' AND metric = 'mcc')),
tea AS (SELECT * FROM res_t UNION ALL SELECT * FROM res_t WHERE task_name = 'en' AND metric = 'f1')
SELECT r.task_name, r.model, r.split, r.metric, round(r.value, 6) AS random,
       round(e.value, 6) AS experiment, round(t.value, 6) AS teacher
FROM res_r r LEFT JOIN exp e USING (task_name, model, split, metric)
             LEFT JOIN tea t USING (task_name, model, split, metric)
"""


@query("compare_results", _cmp_sql())
def q_compare_results(spark, sf):
    s = scored_documents(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rnd = s.withColumn("score", (F.col("doc_id") * 7919) % 1000)
    tea = s.join(docs, "doc_id").withColumn("score", F.col("n_chars")).drop("n_chars")

    def res(df):
        wide = M.evaluate(df.withColumnRenamed("lang", "task_name"), ["task_name", "split"])
        return M.results_long(wide.withColumn("model", F.lit("probe")))

    r, e, t = res(rnd), res(s), res(tea)
    e = e.filter(~((F.col("task_name") == "de") & (F.col("metric") == "mcc")))
    t = t.unionByName(t.filter((F.col("task_name") == "en") & (F.col("metric") == "f1")))
    return round6(M.compare_results(r, e, t))


@query("results_sink", f"WITH {SCORED}, {_results_sql('sc', 'length')} "
                       f"SELECT task_name, model, split, metric, round(value, 6) AS value FROM res")
def q_results_sink(spark, sf):
    path = scratch_path(spark, "results")
    ST.write_results(_results(spark, sf), path)
    return round6(ST.read_results(spark, path))
