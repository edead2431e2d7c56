"""Registered queries, step 1: masks, softmax and the distillation losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.constants import USEFUL_CLASSES
from seqlake.operators import losses as L
from seqlake.plans import sqlgen as Q
from seqlake.plans.fixtures import (EMB_STATE_DIMS, embedding_positions, lineitem_positions,
                                    round6, table)
from seqlake.plans.registry import query

# Training parameters of the fixtures (the command-line defaults: T=4, alpha_soft=0.8,
# alpha_sim=1.0).
T, A_SOFT, A_SIM = 4.0, 0.8, 1.0
D = EMB_STATE_DIMS
POS = Q.embedding_positions_cte(D)
POS_LI = Q.lineitem_positions_cte()


# ---------------------------------------------------------------- B3 + D3

@query("position_mask", f"""
WITH {POS}
SELECT vec_id, batch_id, tok FROM pos_rows WHERE tok <> 4
""")
def q_position_mask(spark, sf):
    return L.position_mask(embedding_positions(spark, sf)).select("vec_id", "batch_id", "tok")


@query("positions", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, range(1, 65) t(i)
""")
def q_positions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = L.positions(e, ["embedding"]).withColumnRenamed("embedding", "value")
    return round6(out.select("vec_id", "pos", F.col("value").cast("double").alias("value")))


# ---------------------------------------------------------------- B4

_B4_COLS = [f"s_c{k}" for k in USEFUL_CLASSES] + [f"t_c{k}" for k in USEFUL_CLASSES]


@query("useful_classes", """
SELECT vec_id, {cols} FROM embeddings
""".replace("{cols}", ", ".join(
    [f"round(CAST(embedding[{k + 1}] AS DOUBLE), 6) AS s_c{k}" for k in USEFUL_CLASSES]
    + [f"round(CAST(embedding[{17 + k}] AS DOUBLE), 6) AS t_c{k}" for k in USEFUL_CLASSES])))
def q_useful_classes(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    # student logits are the first 16 elements, teacher logits the next 16
    e = e.withColumn("teacher", F.slice("embedding", 17, 16))
    out = L.useful_classes(e, "embedding", "s")
    out = L.useful_classes(out, "teacher", "t")
    return round6(out.select("vec_id", *_B4_COLS))


# ---------------------------------------------------------------- E4

@query("log_softmax", f"""
WITH {POS}
SELECT vec_id, {", ".join(Q.r6(e, f"lp_c{k}") for k, e in zip(USEFUL_CLASSES, Q.log_softmax(Q.S_COLS, T)))}
FROM pos_rows
""")
def q_log_softmax(spark, sf):
    df = L.log_softmax_columns(embedding_positions(spark, sf), "s", T)
    return round6(df.select("vec_id", *[f"lp_c{k}" for k in USEFUL_CLASSES]))


# ---------------------------------------------------------------- F3, F4, F5

@query("soft_loss", f"""
WITH {POS}
SELECT batch_id, {Q.r6(f"sum({Q.kl(T)}) / count(*) * {Q.dbl(T * T)}", "soft_loss")},
       count(*) AS n_positions
FROM pos_rows WHERE tok <> 4 GROUP BY batch_id
""")
def q_soft_loss(spark, sf):
    return round6(L.soft_loss(embedding_positions(spark, sf), ["batch_id"], T, A_SOFT))


@query("hard_loss", f"""
WITH {POS}
SELECT batch_id, {Q.r6(f"avg({Q.ce()})", "hard_loss")},
       count(*) FILTER (WHERE tok NOT IN (4, 10, 9, 8, 7)) AS n_invalid_targets
FROM pos_rows WHERE tok <> 4 GROUP BY batch_id
""")
def q_hard_loss(spark, sf):
    return round6(L.hard_loss(embedding_positions(spark, sf), ["batch_id"]))


@query("similarity_loss", f"""
WITH {POS}
SELECT batch_id, {Q.r6(f"{Q.dbl(A_SIM)} * avg({Q.cos_loss(D)})", "similarity_loss")}
FROM pos_rows WHERE tok <> 4 GROUP BY batch_id
""")
def q_similarity_loss(spark, sf):
    return round6(L.similarity_loss(embedding_positions(spark, sf), ["batch_id"], A_SIM, D))


# ---------------------------------------------------------------- F6

def _loss_sql(pos_cte: str, alpha_sim: float, dims: int) -> str:
    cos = f", sum({Q.cos_loss(dims)}) AS c" if alpha_sim > 0 else ""
    parts = Q.contributions("k", "e", "c" if alpha_sim > 0 else None, "n", T, A_SOFT, alpha_sim)
    return f"""
WITH {pos_cte},
agg AS (
  SELECT batch_id, sum({Q.kl(T)}) AS k, sum({Q.ce()}) AS e, count(*) AS n,
         count(*) FILTER (WHERE tok NOT IN (4, 10, 9, 8, 7)) AS n_invalid_targets {cos}
  FROM pos_rows WHERE tok <> 4 GROUP BY batch_id)
SELECT batch_id, {Q.r6(parts["total"], "loss_total")}, {Q.r6(parts["soft"], "loss_soft")},
       {Q.r6(parts["hard"], "loss_hard")}, {Q.r6(parts["hidden_state_sim"], "loss_hidden_state_sim")},
       n AS n_positions, n_invalid_targets
FROM agg
"""


@query("distillation_loss", _loss_sql(POS, A_SIM, D))
def q_distillation_loss(spark, sf):
    return round6(L.distillation_loss(embedding_positions(spark, sf), ["batch_id"],
                                      T, A_SOFT, A_SIM, D))


@query("distillation_loss_lineitem", _loss_sql(POS_LI, 0.0, 0))
def q_distillation_loss_lineitem(spark, sf):
    return round6(L.distillation_loss(lineitem_positions(spark, sf), ["batch_id"],
                                      T, A_SOFT, 0.0, 0))


# ---------------------------------------------------------------- F7, D5, F8

def _dual_sql(rounded: bool = True) -> str:
    ev = Q.contributions("k1", "e", None, "n", **L.EVAL_PARAMS)
    tr = Q.contributions("kt", "e", "c", "n", T, A_SOFT, A_SIM)
    fmt = Q.r6 if rounded else (lambda e, a: f"{e} AS {a}")
    cols = [fmt(ev[p], f"loss_{p}") for p in L.LOSS_PARTS]
    cols += [fmt(tr[p], f"loss_train_temp_{p}") for p in L.LOSS_PARTS]
    return f"""
WITH {POS},
agg AS (
  SELECT batch_id,
         sum(CASE WHEN tok <> 4 THEN {Q.kl(1.0)} END) AS k1,
         sum(CASE WHEN tok <> 4 THEN {Q.kl(T)} END) AS kt,
         sum(CASE WHEN tok <> 4 THEN {Q.ce()} END) AS e,
         sum(CASE WHEN tok <> 4 THEN {Q.cos_loss(D)} END) AS c,
         count(*) FILTER (WHERE tok <> 4) AS n,
         count(*) FILTER (WHERE pos = 0) AS batch_size
  FROM pos_rows GROUP BY batch_id),
report AS (
  SELECT batch_id, {", ".join(cols)}, n AS n_positions, batch_size FROM agg WHERE n > 0)
"""


_VALUE_COLS = ", ".join([f"loss_{p}" for p in L.LOSS_PARTS]
                        + [f"loss_train_temp_{p}" for p in L.LOSS_PARTS])
_NAME = """concat_ws('/', 'val', CASE WHEN starts_with(_name, 'loss_train_temp_')
                                  THEN 'loss_train_temp' ELSE 'loss' END,
                 regexp_replace(_name, '^loss_(train_temp_)?', '')) AS metric"""


def _dual(spark, sf):
    return L.dual_loss_report(embedding_positions(spark, sf), ["batch_id"], T, A_SOFT, A_SIM, D)


@query("loss_empty_batches", """
SELECT CAST(vec_id // 10 AS BIGINT) AS batch_id,
       count(*) FILTER (WHERE vec_id // 10 % 7 <> 0 AND vec_id % 10 <> 3) AS n_positions,
       vec_id // 10 % 7 <> 0 AS has_loss, count(*) AS batch_size
FROM embeddings GROUP BY ALL
""")
def q_loss_empty_batches(spark, sf):
    """F6 and F7 on batches of which every seventh holds PAD only: no batch disappears."""
    p = embedding_positions(spark, sf)
    p = p.withColumn("tok", F.when(F.col("batch_id") % 7 == 0, F.lit(4).cast("bigint")).otherwise(F.col("tok")))
    one = L.distillation_loss(p, ["batch_id"], 2.0, 0.7, 0.5, EMB_STATE_DIMS)
    two = L.dual_loss_report(p, ["batch_id"], 2.0, 0.7, 0.5, EMB_STATE_DIMS)
    two = two.select("batch_id", "batch_size", F.col("n_positions").alias("_n"),
                     F.col("loss_train_temp_total").isNotNull().alias("_has"))
    j = one.join(two, "batch_id", "full").filter("n_positions <=> _n AND (loss_total IS NOT NULL) <=> _has")
    return j.select("batch_id", "n_positions", F.col("loss_total").isNotNull().alias("has_loss"), "batch_size")


_EVERY_7TH = "CASE WHEN vec_id // 10 % 7 = 0 THEN 4 ELSE tok END"


@query("loss_empty_parts", f"""
WITH {POS}, p AS (SELECT * REPLACE ({_EVERY_7TH} AS tok) FROM pos_rows)
SELECT batch_id, {Q.r6(f"avg(CASE WHEN tok <> 4 THEN {Q.kl(T)} END) * {Q.dbl(T * T)}", "soft_loss")},
       count(*) FILTER (WHERE tok <> 4) AS n_positions,
       {Q.r6(f"avg(CASE WHEN tok <> 4 THEN {Q.ce()} END)", "hard_loss")},
       {Q.r6(f"{Q.dbl(A_SIM)} * avg(CASE WHEN tok <> 4 THEN {Q.cos_loss(D)} END)", "similarity_loss")}
FROM p GROUP BY batch_id
""")
def q_loss_empty_parts(spark, sf):
    """F3, F4 and F5 on batches of which every seventh holds PAD only: no batch disappears."""
    p = embedding_positions(spark, sf)
    p = p.withColumn("tok", F.when(F.col("batch_id") % 7 == 0, F.lit(4).cast("bigint")).otherwise(F.col("tok")))
    out = L.soft_loss(p, ["batch_id"], T, A_SOFT).join(L.hard_loss(p, ["batch_id"]), "batch_id") \
        .join(L.similarity_loss(p, ["batch_id"], A_SIM, D), "batch_id")
    return round6(out.drop("n_invalid_targets"))


@query("dual_loss_report", _dual_sql() + "SELECT * FROM report")
def q_dual_loss_report(spark, sf):
    return round6(_dual(spark, sf))


@query("metrics_long", _dual_sql() + f""",
long AS (UNPIVOT report ON {_VALUE_COLS} INTO NAME _name VALUE value)
SELECT batch_id, {_NAME}, value, batch_size FROM long
""")
def q_metrics_long(spark, sf):
    return round6(L.metrics_long(_dual(spark, sf), ["batch_id"], "val"))


@query("epoch_metrics", _dual_sql(rounded=False) + f""",
long AS (UNPIVOT report ON {_VALUE_COLS} INTO NAME _name VALUE value),
named AS (SELECT {_NAME}, value, batch_size FROM long)
SELECT metric, {Q.r6("sum(value * batch_size) / sum(batch_size)", "value")},
       count(*) AS n_batches
FROM named GROUP BY metric
""")
def q_epoch_metrics(spark, sf):
    long = L.metrics_long(_dual(spark, sf), ["batch_id"], "val")
    return round6(L.epoch_metrics(long))


# ---------------------------------------------------------------- C4

@query("align_teacher_student", f"""
WITH {POS}
SELECT vec_id, batch_id, tok,
       {", ".join(Q.r6(c, c) for c in Q.S_COLS + Q.T_COLS)},
       {Q.r6(Q.kl(T), "kl")}
FROM pos_rows
""")
def q_align_teacher_student(spark, sf):
    pos = embedding_positions(spark, sf)
    student = pos.select(F.col("vec_id").alias("sample"), "pos", "batch_id", "tok", *Q.S_COLS)
    teacher = pos.select(F.col("vec_id").alias("sample"), "pos", *Q.T_COLS)
    aligned = L.align_teacher_student(student, teacher, ["sample", "pos"])
    kl = L.with_terms(aligned, [T]).select("*", L.kl_column(T).alias("kl"))
    return round6(kl.select(F.col("sample").alias("vec_id"), "batch_id", "tok",
                            *Q.S_COLS, *Q.T_COLS, "kl"))
