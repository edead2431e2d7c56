"""Distillation losses over position rows.

Input layout ("position rows"): one row per (sample, position) with

* the grouping key(s), e.g. ``batch_id``, and ``sample``;
* ``tok``: the target token id;
* ``s_c{k}`` / ``t_c{k}``: student / teacher logit of class ``k`` for each useful class;
* optionally ``s_h{i}`` / ``t_h{i}``, ``i < state_dims``: the last hidden state.

Everything is a scalar column, so the per-row terms stay in whole-stage codegen, and every
loss is one ``groupBy(key).agg`` of sums and counts: map-side partial aggregation, one
shuffle of a few numbers per (key, partition). A hot key only adds to its partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.constants import COSINE_EPS, PAD_ID, POSITION_BLOCK, USEFUL_CLASSES
from seqlake.functions.softmax import logsumexp

INF = float("inf")


def student_cols(classes: Sequence[int] = USEFUL_CLASSES) -> list[str]:
    return [f"s_c{k}" for k in classes]


def teacher_cols(classes: Sequence[int] = USEFUL_CLASSES) -> list[str]:
    return [f"t_c{k}" for k in classes]


def state_cols(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}_h{i}" for i in range(dims)]


# ---------------------------------------------------------------- B14: argument contract

def validate_loss_args(temperature: float, alpha_soft: float, alpha_sim: float = 0.0,
                       student_state_dims: int = 0, teacher_state_dims: int = 0) -> None:
    """Driver-side checks made before any job is planned."""
    if not temperature > 0:
        raise ValueError(f"temperature {temperature!r}: logits are divided by it, choose a number above 0")
    if not 0.0 <= alpha_soft <= 1.0:
        raise ValueError(f"alpha_soft {alpha_soft!r}: it is the soft loss's share of 1, choose 0 to 1")
    if alpha_sim < 0:
        raise ValueError(f"alpha_sim {alpha_sim!r}: a negative weight rewards distance, choose 0 (off) or more")
    if (student_state_dims > 0) != (teacher_state_dims > 0):
        raise ValueError(f"hidden states of {student_state_dims} and {teacher_state_dims} dimensions: pass those of both models or of neither")
    if student_state_dims != teacher_state_dims:
        raise ValueError(f"hidden states of {student_state_dims} and {teacher_state_dims} dimensions cannot be compared: project one side first")
    if alpha_sim > 0 and student_state_dims == 0:
        raise ValueError(f"alpha_sim {alpha_sim!r} weighs hidden states, but none are given: pass them or set it to 0")


# ---------------------------------------------------------------- B3, B4, D3, E4

def position_mask(df: DataFrame, tok_col: str = "tok") -> DataFrame:
    """Drop positions whose target is PAD; logits and states go with the row."""
    return df.filter(F.col(tok_col) != F.lit(PAD_ID))


def useful_classes(df: DataFrame, logits_col: str, prefix: str,
                   classes: Sequence[int] = USEFUL_CLASSES, drop: bool = True) -> DataFrame:
    """Pull the useful classes out of a full logits array into scalar columns.

    Class ``k`` is array element ``k + 1``. The other classes are simply not carried, which
    is what masking them to -inf does for both softmaxes over the useful set.
    """
    out = df.withColumns({f"{prefix}_c{k}": F.element_at(F.col(logits_col), k + 1).cast("double")
                          for k in classes})
    return out.drop(logits_col) if drop else out


def positions(df: DataFrame, array_cols: Sequence[str], pos_col: str = "pos") -> DataFrame:
    """D3: ``[T, ...]`` arrays of one row -> one row per position (arrays zipped by index)."""
    keep = [c for c in df.columns if c not in array_cols]
    zipped = F.arrays_zip(*[F.col(c) for c in array_cols])
    return (df.select(*keep, F.posexplode(zipped).alias(pos_col, "_z"))
              .select(*keep, pos_col, *[F.col("_z")[c].alias(c) for c in array_cols]))


def block_positions(df: DataFrame, logits: dict[str, str], ids_col: str = "input_ids",
                    classes: Sequence[int] = USEFUL_CLASSES, block: int = POSITION_BLOCK) -> DataFrame:
    """M6 rows -> one row per position: ``pos`` in the sample, ``tok``, and for each
    ``prefix: column`` of ``logits`` the position's logits as ``{prefix}_c{k}``."""
    keep = [c for c in df.columns if c not in (ids_col, "block", *logits.values())]
    width = len(classes)

    # the arrays are indexed after the explode, in generated code: no row holds its positions as structs
    out = df.select(*keep, "block", *logits.values(), F.posexplode(ids_col).alias("_i", "_tok"))
    return out.select(*keep, (F.col("block") * F.lit(block) + F.col("_i")).alias("pos"),
                      F.col("_tok").cast("bigint").alias("tok"), *[
        F.get(column, F.col("_i") * F.lit(width) + F.lit(j)).cast("double").alias(f"{prefix}_c{k}")
        for prefix, column in logits.items() for j, k in enumerate(classes)])


def log_softmax_columns(df: DataFrame, prefix: str, temperature: float = 1.0,
                        out_prefix: str = "lp", classes: Sequence[int] = USEFUL_CLASSES) -> DataFrame:
    """Log-softmax over the useful classes of one model, as ``{out_prefix}_c{k}``. The
    log-sum-exp is computed once per row (a column), then subtracted per class."""
    cols = [F.col(f"{prefix}_c{k}") for k in classes]
    lse_col = f"_{out_prefix}_lse"
    out = df.withColumn(lse_col, logsumexp([c / F.lit(float(temperature)) for c in cols]))
    out = out.withColumns({f"{out_prefix}_c{k}": c / F.lit(float(temperature)) - F.col(lse_col)
                           for k, c in zip(classes, cols)})
    return out.drop(lse_col)


# ---------------------------------------------------------------- per-row terms
#
# The terms are built in stages (row max, log-sum-exp, log-probabilities, then KL / CE /
# cosine) as separate columns. Each stage is referenced several times by the next, so
# Catalyst keeps the projections apart instead of inlining one huge expression tree, and
# the generated code stays small enough to be JIT-compiled.

def _tname(temperature: float) -> str:
    return repr(float(temperature)).replace(".", "_").replace("-", "m").replace("+", "")


def _d(x: float) -> str:
    """Double literal in Spark SQL."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def with_terms(df: DataFrame, temperatures: Sequence[float] = (), ce: bool = False,
               state_dims: int = 0) -> DataFrame:
    """Add per-row ``_kl_{T}`` for each temperature, ``_ce`` and ``_cos`` as requested.

    Five batched projections: row maxima, log-sum-exp, log-probabilities, then the terms.
    They are written as SQL expression strings (``selectExpr``): one call per stage instead
    of thousands of driver round trips to build the same expression tree.
    """
    want_t = {float(x) for x in temperatures}
    temps = sorted(want_t | ({1.0} if ce else set()))
    sides = {"s": student_cols(), "t": teacher_cols()}
    need = [(p, t) for t in temps for p in ("s", "t") if p == "s" or t in want_t]

    def tag(p, t):
        return f"_{p}{_tname(t)}"

    def scaled(p, t):
        return [f"({c} / {_d(t)})" for c in sides[p]]

    out = df.selectExpr("*", *[f"greatest({', '.join(sides[p])}) / {_d(t)} AS {tag(p, t)}_m"
                               for p, t in need])
    out = out.selectExpr("*", *[
        f"{tag(p, t)}_m + ln({' + '.join(f'exp({x} - {tag(p, t)}_m)' for x in scaled(p, t))}) "
        f"AS {tag(p, t)}_lse" for p, t in need])
    out = out.selectExpr("*", *[f"{x} - {tag(p, t)}_lse AS {tag(p, t)}_lp{k}"
                                for p, t in need for k, x in zip(USEFUL_CLASSES, scaled(p, t))])
    terms = []
    for temp in sorted(want_t):
        ts, tt = tag("s", temp), tag("t", temp)
        kl = " + ".join(f"exp({tt}_lp{k}) * ({tt}_lp{k} - {ts}_lp{k})" for k in USEFUL_CLASSES)
        terms.append(f"{kl} AS _kl_{_tname(temp)}")
    if ce:
        # a target outside the useful set costs +inf (kept on purpose, see n_invalid_targets)
        at = " ".join(f"WHEN {k} THEN -{tag('s', 1.0)}_lp{k}" for k in USEFUL_CLASSES)
        terms.append(f"CASE tok {at} ELSE CAST('Infinity' AS DOUBLE) END AS _ce")
    if state_dims:
        s, t = state_cols("s", state_dims), state_cols("t", state_dims)

        def dots(a, b):
            return " + ".join(f"{x} * {y}" for x, y in zip(a, b))

        terms += [f"{dots(s, t)} AS _dot", f"{dots(s, s)} AS _ss", f"{dots(t, t)} AS _tt"]
    out = out.selectExpr("*", *terms)
    if state_dims:
        eps = _d(COSINE_EPS)
        out = out.selectExpr("*", f"1.0D - _dot / sqrt((_ss + {eps}) * (_tt + {eps})) AS _cos")
    return out


def kl_column(temperature: float) -> Column:
    """The per-row KL term added by :func:`with_terms` for ``temperature``."""
    return F.col(f"_kl_{_tname(temperature)}")


def _kl(temperature: float) -> Column:
    return F.col(f"_kl_{_tname(temperature)}")


def _ce() -> Column:
    return F.col("_ce")


def _cos_loss(state_dims: int) -> Column:
    return F.col("_cos")


# ---------------------------------------------------------------- F3-F6

def _masked(col: Column) -> Column:
    """``col`` on non-PAD positions, NULL on the others: the mask sits inside the aggregates, so
    that a group without any position left keeps its row."""
    return F.when(F.col("tok") != F.lit(PAD_ID), col)


def soft_loss(df: DataFrame, group_cols: Sequence[str], temperature: float,
              alpha_soft: float) -> DataFrame:
    """KL(teacher || student) summed over classes, averaged over non-PAD positions;
    times T^2 only when ``alpha_soft != 1``. Not weighted by alpha_soft. A group of PAD only
    keeps its row, with a NULL loss over 0 positions."""
    scale = temperature ** 2 if alpha_soft != 1.0 else 1.0
    return (with_terms(df, [temperature]).groupBy(*group_cols)
            .agg((F.avg(_masked(_kl(temperature))) * F.lit(scale)).alias("soft_loss"),
                 F.count(_masked(F.lit(1))).alias("n_positions")))


def hard_loss(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """mean cross entropy of the student over non-PAD positions (NULL without any)."""
    invalid = F.count_if(F.coalesce(_masked(~F.col("tok").isin(*USEFUL_CLASSES)), F.lit(False)))
    return (with_terms(df, ce=True).groupBy(*group_cols)
            .agg(F.avg(_masked(_ce())).alias("hard_loss"), invalid.alias("n_invalid_targets")))


def similarity_loss(df: DataFrame, group_cols: Sequence[str], alpha_sim: float,
                    state_dims: int) -> DataFrame:
    """``alpha_sim * mean(1 - cos)`` over non-PAD positions (NULL without any); exactly 0.0
    when ``alpha_sim == 0``."""
    value = (F.lit(float(alpha_sim)) * F.avg(_masked(_cos_loss(state_dims)))
             if alpha_sim > 0 else F.max(_masked(F.lit(0.0))))
    terms = with_terms(df, state_dims=state_dims if alpha_sim > 0 else 0)
    return terms.groupBy(*group_cols).agg(value.alias("similarity_loss"))


def _contributions(sum_kl: Column, sum_ce: Column, sum_cos: Column | None, n: Column,
                   temperature: float, alpha_soft: float, alpha_sim: float) -> dict[str, Column]:
    scale = temperature ** 2 if alpha_soft != 1.0 else 1.0
    soft = F.lit(float(alpha_soft)) * (sum_kl / n * F.lit(scale))
    # 0 * inf is NaN on purpose: a target outside the useful set poisons the total.
    hard = F.lit(1.0 - alpha_soft) * (sum_ce / n)
    sim = (F.lit(float(alpha_sim)) * (sum_cos / n)) if alpha_sim > 0 else F.when(n > 0, F.lit(0.0))
    return {"total": soft + hard + sim, "soft": soft, "hard": hard, "hidden_state_sim": sim}


def distillation_loss(df: DataFrame, group_cols: Sequence[str], temperature: float,
                      alpha_soft: float, alpha_sim: float, state_dims: int = 0) -> DataFrame:
    """total loss and the three weighted contributions per group, in one aggregation.
    A group without non-PAD positions keeps its row: ``n_positions`` 0 and NULL losses."""
    validate_loss_args(temperature, alpha_soft, alpha_sim, state_dims, state_dims)
    masked = F.col("tok") != F.lit(PAD_ID)

    def msum(col: Column) -> Column:
        return F.sum(F.when(masked, col))

    sums = [msum(_kl(temperature)).alias("_kl"), msum(_ce()).alias("_ce"),
            F.count_if(masked).alias("n_positions"),
            F.count_if(masked & ~F.col("tok").isin(*USEFUL_CLASSES)).alias("n_invalid_targets")]
    if alpha_sim > 0:
        sums.append(msum(_cos_loss(state_dims)).alias("_cos"))
    terms = with_terms(df, [temperature], ce=True,
                       state_dims=state_dims if alpha_sim > 0 else 0)
    agg = terms.groupBy(*group_cols).agg(*sums)
    parts = _contributions(F.col("_kl"), F.col("_ce"), F.col("_cos") if alpha_sim > 0 else None,
                           F.col("n_positions"), temperature, alpha_soft, alpha_sim)
    return agg.select(*group_cols,
                      parts["total"].alias("loss_total"), parts["soft"].alias("loss_soft"),
                      parts["hard"].alias("loss_hard"),
                      parts["hidden_state_sim"].alias("loss_hidden_state_sim"),
                      "n_positions", "n_invalid_targets")


# ---------------------------------------------------------------- F7, D5, F8

EVAL_PARAMS = {"temperature": 1.0, "alpha_soft": 1.0, "alpha_sim": 0.0}
LOSS_PARTS = ("total", "soft", "hard", "hidden_state_sim")


def dual_loss_report(df: DataFrame, group_cols: Sequence[str], temperature: float,
                     alpha_soft: float, alpha_sim: float, state_dims: int = 0,
                     pos_col: str = "pos") -> DataFrame:
    """the loss under eval parameters (T=1, alpha_soft=1, alpha_sim=0) and under the
    training parameters, both from ONE pass over the positions.

    ``batch_size`` is the number of samples in the group before masking (the weight used
    by the epoch mean, F8), counted as rows at position 0 -- no distinct aggregate.
    """
    validate_loss_args(temperature, alpha_soft, alpha_sim, state_dims, state_dims)
    masked = F.col("tok") != F.lit(PAD_ID)

    def msum(col: Column) -> Column:
        return F.sum(F.when(masked, col))

    sums = [msum(_kl(1.0)).alias("_kl1"), msum(_kl(temperature)).alias("_klt"),
            msum(_ce()).alias("_ce"), F.count_if(masked).alias("n_positions"),
            F.count_if(F.col(pos_col) == 0).alias("batch_size")]
    if alpha_sim > 0:
        sums.append(msum(_cos_loss(state_dims)).alias("_cos"))
    terms = with_terms(df, sorted({1.0, float(temperature)}), ce=True,
                       state_dims=state_dims if alpha_sim > 0 else 0)
    # a batch of PAD only keeps its row (n_positions 0, NULL losses): see reject_empty
    agg = terms.groupBy(*group_cols).agg(*sums)
    n = F.col("n_positions")
    ev = _contributions(F.col("_kl1"), F.col("_ce"), None, n, **EVAL_PARAMS)
    tr = _contributions(F.col("_klt"), F.col("_ce"), F.col("_cos") if alpha_sim > 0 else None,
                        n, temperature, alpha_soft, alpha_sim)
    cols = [ev[p].alias(f"loss_{p}") for p in LOSS_PARTS]
    cols += [tr[p].alias(f"loss_train_temp_{p}") for p in LOSS_PARTS]
    return agg.select(*group_cols, *cols, "n_positions", "batch_size")


def reject_empty(report: DataFrame) -> DataFrame:
    """Strict mode for F6 and F7: raises when a group has no position to average over (one
    small job), else returns the report."""
    empty = report.filter(F.col("n_positions") == 0).limit(1).count()
    if empty:
        raise ValueError("a group holds PAD positions only, its loss is undefined")
    return report


def metrics_long(report: DataFrame, group_cols: Sequence[str], prefix: str = "val") -> DataFrame:
    """Wide report -> rows named ``{prefix}/loss/{part}`` and
    ``{prefix}/loss_train_temp/{part}``."""
    value_cols = [f"loss_{p}" for p in LOSS_PARTS] + [f"loss_train_temp_{p}" for p in LOSS_PARTS]
    long = report.unpivot(list(group_cols) + ["batch_size"], value_cols, "_name", "value")
    kind = F.when(F.col("_name").startswith("loss_train_temp_"), F.lit("loss_train_temp")) \
            .otherwise(F.lit("loss"))
    part = F.regexp_replace(F.col("_name"), "^loss_(train_temp_)?", "")
    return long.select(*group_cols, F.concat_ws("/", F.lit(prefix), kind, part).alias("metric"),
                       "value", "batch_size")


def epoch_metrics(long: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """F8: epoch value = mean of batch values weighted by batch size. Batches without a value
    (PAD only) weigh nothing and are not counted."""
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("batch_size")))
    return long.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("value") * F.col("batch_size")), weight).alias("value"),
        F.count("value").alias("n_batches"))


# ---------------------------------------------------------------- C4

def align_teacher_student(student: DataFrame, teacher: DataFrame,
                          keys: Sequence[str] = ("sample", "pos")) -> DataFrame:
    """C4: put both models' outputs for the same positions on one row (inner equi-join).

    Both sides are large; the join shuffles on the full key. Stores that are read as tables
    bucketed by it (:func:`seqlake.sources.delta_store.bucketed`) are joined without a shuffle.
    """
    return student.join(teacher, on=list(keys), how="inner")
