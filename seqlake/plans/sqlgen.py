"""Small helpers that spell the oracle SQL (DuckDB dialect) of the fixtures and losses.

Only string building for the oracle side; the Spark side never goes through SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from seqlake.constants import USEFUL_CLASSES

S_COLS = [f"s_c{k}" for k in USEFUL_CLASSES]


def dbl(x: float) -> str:
    """A double literal (a bare ``0.2`` would be DECIMAL in DuckDB)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


T_COLS = [f"t_c{k}" for k in USEFUL_CLASSES]


def lse(cols: Sequence[str], temperature: float = 1.0) -> str:
    scaled = [f"({c} / {dbl(temperature)})" for c in cols]
    m = f"greatest({', '.join(scaled)})"
    return f"({m} + ln({' + '.join(f'exp({s} - {m})' for s in scaled)}))"


def log_softmax(cols: Sequence[str], temperature: float = 1.0) -> list[str]:
    z = lse(cols, temperature)
    return [f"(({c} / {dbl(temperature)}) - {z})" for c in cols]


def kl(temperature: float) -> str:
    s = log_softmax(S_COLS, temperature)
    t = log_softmax(T_COLS, temperature)
    return "(" + " + ".join(f"exp({tl}) * ({tl} - {sl})" for tl, sl in zip(t, s)) + ")"


def ce() -> str:
    at = " ".join(f"WHEN {k} THEN s_c{k}" for k in USEFUL_CLASSES)
    classes = ", ".join(str(k) for k in USEFUL_CLASSES)
    return (f"(CASE WHEN tok IN ({classes}) THEN {lse(S_COLS)} - (CASE tok {at} END) "
            f"ELSE CAST('inf' AS DOUBLE) END)")


def dot(a: Sequence[str], b: Sequence[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cos_loss(dims: int) -> str:
    s = [f"s_h{i}" for i in range(dims)]
    t = [f"t_h{i}" for i in range(dims)]
    eps = dbl(1e-12)
    return f"({dbl(1.0)} - {dot(s, t)} / sqrt(({dot(s, s)} + {eps}) * ({dot(t, t)} + {eps})))"


def embedding_positions_cte(state_dims: int = 16) -> str:
    cols = ["vec_id", "vec_id AS sample", "0 AS pos", "CAST(vec_id // 10 AS BIGINT) AS batch_id",
            "CAST(CASE WHEN vec_id % 10 = 3 THEN 4 ELSE vec_id % 4 + 7 END AS BIGINT) AS tok"]
    cols += [f"CAST(embedding[{k + 1}] AS DOUBLE) AS s_c{k}" for k in USEFUL_CLASSES]
    cols += [f"CAST(embedding[{17 + k}] AS DOUBLE) AS t_c{k}" for k in USEFUL_CLASSES]
    cols += [f"CAST(embedding[{33 + i}] AS DOUBLE) AS s_h{i}" for i in range(state_dims)]
    cols += [f"CAST(embedding[{49 + i}] AS DOUBLE) AS t_h{i}" for i in range(state_dims)]
    return "pos_rows AS (SELECT " + ", ".join(cols) + " FROM embeddings)"


def lineitem_positions_cte() -> str:
    vals = ["l_quantity / 10", "l_extendedprice / 10000", "l_discount * 10", "l_tax * 10",
            "CAST(l_linenumber AS DOUBLE)"]
    rotated = vals[2:] + vals[:2]
    cols = ["l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber AS sample", "0 AS pos",
            "l_suppkey AS batch_id",
            "CAST([4, 7, 8, 9, 10][CAST(l_partkey % 5 + 1 AS INTEGER)] AS BIGINT) AS tok"]
    cols += [f"CAST({v} AS DOUBLE) AS s_c{k}" for k, v in zip(USEFUL_CLASSES, vals)]
    cols += [f"CAST({v} AS DOUBLE) AS t_c{k}" for k, v in zip(USEFUL_CLASSES, rotated)]
    return "pos_rows AS (SELECT " + ", ".join(cols) + " FROM lineitem)"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def contributions(kl_sum: str, ce_sum: str, cos_sum: str | None, n: str, temperature: float,
                  alpha_soft: float, alpha_sim: float) -> dict[str, str]:
    scale = temperature ** 2 if alpha_soft != 1.0 else 1.0
    soft = f"({dbl(alpha_soft)} * ({kl_sum} / {n} * {dbl(scale)}))"
    hard = f"({dbl(1.0 - alpha_soft)} * ({ce_sum} / {n}))"
    sim = f"({dbl(alpha_sim)} * ({cos_sum} / {n}))" if alpha_sim > 0 else "CAST(0.0 AS DOUBLE)"
    return {"total": f"({soft} + {hard} + {sim})", "soft": soft, "hard": hard,
            "hidden_state_sim": sim}
