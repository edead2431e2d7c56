"""Embedding columns as rows of 8-byte floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(batches: Iterator[pa.RecordBatch], zero: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dims, data = [], [], []
        for i, v in enumerate(batch.column(1).to_pylist()):
            if not v or None in v:
                continue
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and (zero or x.any()):
                keep.append(i)
                dims.append(len(x))
                data.append(x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()),
             pa.array(data, pa.binary())], names=["vec_id", "dim", "vec"])


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool = True) -> DataFrame:
    """``vec_id, dim, vec`` (little-endian doubles) of the vectors without nulls and non-finite
    components; null and empty vectors are left out, with ``zero=False`` zero vectors too."""
    return vectors.select(F.col(id_col).cast("bigint"), F.col(vec_col)).mapInArrow(
        lambda it: _usable(it, zero), "vec_id bigint, dim int, vec binary")


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow binary column, one per row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the given rows scaled by powers of two (their cosines are the
    same, and squares neither overflow nor vanish)."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -e[:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True), x
