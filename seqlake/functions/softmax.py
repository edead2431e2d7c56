"""Numerically stable softmax pieces over a handful of scalar columns.

Logits are kept as separate scalar columns so everything stays inside whole-stage codegen;
array lambdas would be slower in the hot path. ``ln`` of a probability is never taken: in
Spark ``ln(0)`` is NULL, which aggregates would then skip silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def logsumexp(cols: list[Column]) -> Column:
    """``log(sum(exp(x)))`` shifted by the row maximum."""
    m = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return m + F.log(_sum([F.exp(c - m) for c in cols]))
