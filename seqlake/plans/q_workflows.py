
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqlake.constants import USEFUL_CLASSES
from seqlake.functions import tokens as TK
from seqlake.operators import indexing as IX
from seqlake.operators import losses as L
from seqlake.operators import probes as PR
from seqlake.operators import tiling as TL
from seqlake.plans import sqlgen as Q
from seqlake.plans.fixtures import (BATCH, CHUNK, OVERLAP, SEGMENT, TILE, bed_file, broken_intervals,
                                    contig_length_table, round6, table, token_chunk_table,
                                    whole_intervals)
from seqlake.plans.q_tiling import BAD_IV, IV_WHOLE, SEQS, TRAIN_IDX
from seqlake.plans.registry import query
from seqlake.session import scratch_path
from seqlake.sources import delta_store as DS
from seqlake.sources.bed import bed_scan

# ---------------------------------------------------------------- §3.1 soft-label generation


def one_hot_model():
    """A frozen toy model: the 5 logits of a position are 1 for the class it holds, else 0."""
    classes = np.asarray(USEFUL_CLASSES)

    def predict(x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] == classes[None, None, :]).astype(np.float32)

    return predict


BLOCK_KEY = ["sample", "block"]
_LOGIT_COLS = [f"logit_c{k}" for k in USEFUL_CLASSES]


def _count_sql(ids: str, ch: str) -> str:
    return f"(length({ids}) - length(replace({ids}, '{ch}', '')))"


_IDS_SQL = f"""translate(translate(regexp_replace(translate(substring(seqs.seq, CAST(start + 1 AS BIGINT), {TILE}),
                   'acgtn', 'ACGTN'), '[^ACGNT]', '6', 'g'), 'ACGTN', '789:;'), ';', '4')"""


def label_tiles(spark, sf, intervals, path, strict=False):
    """Tiles with their token ids, checked: C2 -> D1 -> C1 + E1-E3 -> E2 -> B2, B5 and C1's guard
    -> kept tiles, quarantined tiles and counts (:func:`enforce_contract`). Tails of contigs are
    padded. The genome is tokenized once (read-through), tiles are cut from the token string. The
    lengths are joined to the intervals, of which there are fewer than tiles."""
    tiles = TL.tile(TL.contig_bounds(intervals, contig_length_table(spark, sf)), TILE, SEGMENT,
                    interval_idx="interval_idx")
    tok = TL.tile_tokens(tiles, token_chunk_table(spark, sf), CHUNK, OVERLAP, TILE, tokenized=True, how="left")
    inside = (F.col("start") >= 0) & (F.length("ids") > 0)      # an empty or foreign piece is not padded
    tok = tok.withColumn("ids", F.when(inside, TK.pad_truncate(F.col("ids"), TILE)))
    return TL.enforce_contract(tok, path, TILE, SEGMENT, pad_tail=True, strict=strict)


@query("soft_label_generation", f"""
WITH {IV_WHOLE}, {SEQS}, {TRAIN_IDX},
tok AS (
  SELECT ix.chr_name, ix.start, ix."end", ix.idx, rpad({_IDS_SQL}, {TILE}, '4') AS ids
  FROM ix JOIN seqs ON seqs.contig = ix.chr_name WHERE ix.start < length(seqs.seq))
SELECT idx AS sample, CAST(idx // {BATCH} AS BIGINT) AS batch_idx, chr_name, start, "end",
       {", ".join(f"round({_count_sql('ids', TK.id_char(k))} / {float(TILE)!r}, 6) AS logit_c{k}"
                  for k in USEFUL_CLASSES)}
FROM tok WHERE replace(ids, '4', '') <> ''
""")
def q_soft_label_generation(spark, sf):
    """A1 -> B1 -> D4 -> D1 -> C1 + E1-E3 -> E2 -> B2, B5 -> D2 -> H1 -> A4 (read back), over every
    character of the train documents. Token ids stay in the compact string form up to the model."""
    iv = TL.split_filter(bed_scan(spark, bed_file(spark, sf, whole_intervals), with_order=True), "train")
    iv = IX.global_index(iv, ["file_order"], "interval_idx").drop("file_order")
    kept, _, _ = label_tiles(spark, sf, iv, scratch_path(spark, "tiles"))
    tok = IX.batch(kept, BATCH).withColumnRenamed("idx", "sample")
    tile = ["sample", "batch_idx", "chr_name", "start", "end"]
    store = scratch_path(spark, "soft-label-gen")
    DS.append_soft_labels(PR.score_token_positions(tok, one_hot_model, tile), store, BLOCK_KEY)
    # read back: the stored logits of a tile, averaged over its positions
    per = L.block_positions(DS.read_soft_labels(spark, store, BLOCK_KEY), {"logit": "logits"})
    return round6(per.groupBy(*tile).agg(*[F.avg(c).alias(c) for c in _LOGIT_COLS]).select(*tile, *_LOGIT_COLS))


def _reasons_sql() -> str:
    checks = {
        "bad_segment_length": f"interval_end - interval_start <> {SEGMENT}",
        "tile_past_interval_end": '"end" > interval_end', "tile_before_interval_start": "start < interval_start",
        "negative_start": "start < 0", "tile_past_contig_end": "start >= contig_len",
        "unknown_contig": "contig_len IS NULL", "bad_token_count": f"length(ids) <> {TILE}",
        "all_pad": "ids <> '' AND replace(ids, '4', '') = ''"}
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + ")"


def _tested_tiles_sql() -> str:
    return f"""
WITH {IV_WHOLE}, {SEQS}, {BAD_IV},
t AS (
  SELECT b.chr_name, b.split, b.start AS interval_start, b."end" AS interval_end, b.start + r.t * {TILE} AS start,
         b.start + (r.t + 1) * {TILE} AS "end", CAST(r.t AS INTEGER) AS tile_idx, lens.contig_len
  FROM bad b LEFT JOIN lens USING (chr_name), (SELECT unnest(range(0, {SEGMENT // TILE})) AS t) r),
i AS (
  SELECT t.*, CASE WHEN start >= 0 AND start < contig_len THEN rpad({_IDS_SQL}, {TILE}, '4') ELSE '' END AS ids
  FROM t LEFT JOIN seqs ON seqs.contig = t.chr_name),
c AS (SELECT *, {_reasons_sql()} AS reasons FROM i)"""


def _tested_intervals(spark, sf):
    """Whole documents, and the intervals that break the contract."""
    return whole_intervals(spark, sf).unionByName(broken_intervals(spark, sf))


def _tested(spark, sf):
    iv = bed_scan(spark, bed_file(spark, sf, _tested_intervals)).withColumn("interval_idx", F.lit(0).cast("bigint"))
    return label_tiles(spark, sf, iv, scratch_path(spark, "tested-tiles"))


@query("workflow_rejects", _tested_tiles_sql() + """
SELECT chr_name, split, tile_idx, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", reasons
FROM c WHERE reasons <> ''""")
def q_workflow_rejects(spark, sf):
    """B2, B5 and C1's guard in the workflow: the quarantined tiles with all their reasons."""
    _, rejected, _ = _tested(spark, sf)
    return rejected.select("chr_name", "split", "tile_idx", "start", "end",
                           F.array_join("reasons", ",").alias("reasons"))


@query("workflow_reasons", _tested_tiles_sql() + """,
r AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM c WHERE reasons <> '')
SELECT reason, count(*) AS n_tiles FROM r GROUP BY reason
UNION ALL SELECT 'n_rejected', count(*) FROM c WHERE reasons <> ''
UNION ALL SELECT 'n_tiles', count(*) FROM c""")
def q_workflow_reasons(spark, sf):
    """The counts that the same pass observes, by reason."""
    _, _, counts = _tested(spark, sf)
    return spark.createDataFrame(sorted((k, v) for k, v in counts.items() if v), "reason string, n_tiles bigint")


# ---------------------------------------------------------------- §3.2 validation report

T_POS = 2          # positions per sample in the stored outputs
TEMP, A_SOFT = 4.0, 0.8


def _tok_expr(pos_expr: str) -> str:
    return f"CASE WHEN ({pos_expr}) % 10 = 3 THEN 4 ELSE ({pos_expr}) % 4 + 7 END"


def _write_outputs(spark, sf):
    """Paths of a student and a teacher store in block layout (M6), as scoring jobs would
    have written them. Position p of sample ``vec_id`` has student logits at elements 1+32p..,
    teacher logits at 17+32p.., target ``4`` if ``(2*vec_id + p) % 10 = 3`` else
    ``7 + (2*vec_id + p) % 4``."""
    e = table(spark, sf, "embeddings")
    ids = F.array(*[F.expr(_tok_expr(f"vec_id * {T_POS} + {p}")).cast("int") for p in range(T_POS)])
    paths = []
    for name, first in (("student", 1), ("teacher", 17)):
        logits = F.array(*[F.element_at("embedding", first + 32 * p + k).cast("float")
                           for p in range(T_POS) for k in USEFUL_CLASSES])
        rows = e.select(F.col("vec_id").alias("sample"), F.lit(0).alias("block"),
                        F.floor(F.col("vec_id") / 10).cast("bigint").alias("batch_idx"),
                        ids.alias("input_ids"), logits.alias("logits"))
        paths.append(scratch_path(spark, f"{name}-out"))
        DS.append_soft_labels(rows, paths[-1], BLOCK_KEY)
    return paths


def _val_positions_sql() -> str:
    cols = ["vec_id AS sample", "CAST(vec_id // 10 AS BIGINT) AS batch_id", "p AS pos",
            f"CAST({_tok_expr(f'vec_id * {T_POS} + p')} AS BIGINT) AS tok"]
    cols += [f"CAST(embedding[1 + 32 * p + {k}] AS DOUBLE) AS s_c{k}" for k in USEFUL_CLASSES]
    cols += [f"CAST(embedding[17 + 32 * p + {k}] AS DOUBLE) AS t_c{k}" for k in USEFUL_CLASSES]
    return (f"pos_rows AS (SELECT {', '.join(cols)} FROM embeddings, "
            f"(SELECT unnest(range(0, {T_POS})) AS p) r)")


def _validation_sql() -> str:
    ev = Q.contributions("k1", "e", None, "n", **L.EVAL_PARAMS)
    tr = Q.contributions("kt", "e", None, "n", TEMP, A_SOFT, 0.0)
    cols = [f"{ev[p]} AS loss_{p}" for p in L.LOSS_PARTS]
    cols += [f"{tr[p]} AS loss_train_temp_{p}" for p in L.LOSS_PARTS]
    names = ", ".join([f"loss_{p}" for p in L.LOSS_PARTS] + [f"loss_train_temp_{p}" for p in L.LOSS_PARTS])
    return f"""
WITH {_val_positions_sql()},
agg AS (
  SELECT batch_id,
         sum(CASE WHEN tok <> 4 THEN {Q.kl(1.0)} END) AS k1,
         sum(CASE WHEN tok <> 4 THEN {Q.kl(TEMP)} END) AS kt,
         sum(CASE WHEN tok <> 4 THEN {Q.ce()} END) AS e,
         count(*) FILTER (WHERE tok <> 4) AS n,
         count(*) FILTER (WHERE pos = 0) AS batch_size
  FROM pos_rows GROUP BY batch_id),
report AS (SELECT batch_id, {", ".join(cols)}, batch_size FROM agg WHERE n > 0),
long AS (UNPIVOT report ON {names} INTO NAME _name VALUE value),
named AS (SELECT concat_ws('/', 'final_val', CASE WHEN starts_with(_name, 'loss_train_temp_')
                 THEN 'loss_train_temp' ELSE 'loss' END,
                 regexp_replace(_name, '^loss_(train_temp_)?', '')) AS metric, value, batch_size
          FROM long)
SELECT metric, round(sum(value * batch_size) / sum(batch_size), 6) AS value, count(*) AS n_batches
FROM named GROUP BY metric
"""


@query("validation_report", _validation_sql())
def q_validation_report(spark, sf):
    """Stored outputs -> C4 -> D3 -> B4 -> B3 -> F7 -> D5 -> F8 (final validation)."""
    student, teacher = (DS.bucketed(spark, path, BLOCK_KEY) for path in _write_outputs(spark, sf))
    aligned = L.align_teacher_student(
        student.withColumnRenamed("logits", "s_logits"),
        teacher.select("sample", "block", F.col("logits").alias("t_logits")), keys=["sample", "block"])
    pos = L.block_positions(aligned, {"s": "s_logits", "t": "t_logits"})
    pos = pos.select("sample", "pos", F.col("batch_idx").alias("batch_id"), "tok",
                     *L.student_cols(), *L.teacher_cols())
    report = L.dual_loss_report(pos, ["batch_id"], TEMP, A_SOFT, 0.0, 0)
    long = L.metrics_long(report, ["batch_id"], "final_val")
    return round6(L.epoch_metrics(long))
