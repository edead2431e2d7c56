"""Quality classifier: naive Bayes support vectors (NBSVM).

Features are indicators of n-grams: three-byte grams of the text, and grams of one to three
word shapes (capitals, last character, symbols inside, length, whether the word repeats one
of the two before it). Every indicator is scaled by the log-count ratio of its feature between
the two classes, every document to length 1. On these a linear hinge-loss model is fitted by
dual coordinate descent.

The log-count ratios come from all labelled training rows. The dual fit uses the training rows
with the smallest hashes, at most ``FIT_ROWS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seqlake.llm import words
from seqlake.llm.common import SLICE_SCHEMA, maybe_among, slices_of, stored, summed

DIM = 1 << 17          # hashed features
FIT_ROWS = 6000        # training rows of the dual fit, at most
EPOCHS = 15
COST = 1.0             # upper bound of the dual variables
SLOPE = 4.0            # of the logistic function that turns margins into scores

_CHARS = np.zeros(256, dtype=np.uint8)          # 0 letter, 1 digit, 2 sentence mark, 3 other symbol
_CHARS[33:127] = 3
_CHARS[48:58] = 1
_CHARS[65:91] = _CHARS[97:123] = 0
_CHARS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 2
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
                 dtype=np.uint64)


def _slots(x: np.ndarray, salt: int) -> np.ndarray:
    return (words.mix(x + _SALT[salt]) >> np.uint64(47)).astype(np.int32)


def feature_sets(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text of a group, and their bounds."""
    size = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    data = b" ".join(group) + b" "
    b = np.frombuffer(data, dtype=np.uint8)
    wide = b.astype(np.uint64)
    grams = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    own = np.repeat(np.arange(len(group)), size)
    inside = own[2:] == own[:-2]
    values, owner = [_slots(grams[inside], 0)], [own[2:][inside]]

    start, h = words.word_hashes(data)
    if len(start):
        end = np.append(start[1:], len(b))
        upper = np.concatenate(([0], np.cumsum(_UPPER[b])))
        kind = _CHARS[b]
        symbol = np.concatenate(([0], np.cumsum(kind == 3)))
        gap = np.concatenate(([0], np.cumsum(words._SPACE[b])))
        stop = end - (gap[end] - gap[start])          # end of the word: less the gap behind it
        n_upper = upper[stop] - upper[start]
        caps = np.where(n_upper == 0, 0, np.where((n_upper == 1) & _UPPER[b[start]], 1, 2))
        n_symbol = np.minimum(symbol[stop] - symbol[start], 3)
        doc = np.searchsorted(begin, start, side="right") - 1
        again = np.zeros(len(h), dtype=np.int64)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again2 = np.zeros(len(h), dtype=np.int64)
        again2[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
        length = np.minimum(stop - start, 15) // 4
        shape = ((((caps * 4 + kind[stop - 1]) * 4 + n_symbol) * 2 + again) * 2 + again2) * 4 + length
        shape = shape.astype(np.uint64) + np.uint64(1)
        for k in range(3):
            if len(shape) <= k:
                break
            s = shape[:len(shape) - k].copy()
            for j in range(1, k + 1):
                s = (s << np.uint64(12)) | shape[j:len(shape) - k + j]
            same = doc[:len(shape) - k] == doc[k:]
            values.append(_slots(s[same], k + 1))
            owner.append(doc[:len(shape) - k][same])
    value, own = np.concatenate(values), np.concatenate(owner)
    key = np.sort((own.astype(np.int64) << np.int64(17)) | value)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    bounds = np.searchsorted(key, np.arange(len(group) + 1) << 17)
    empty = np.fromiter((not e for e in group), dtype=bool, count=len(group))
    if empty.any():                                   # a text without bytes has no features
        keep = ~empty[key >> 17]
        key = key[keep]
        bounds = np.searchsorted(key, np.arange(len(group) + 1) << 17)
    return (key & (DIM - 1)).astype(np.int32), bounds


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(label, text)`` -> slices of the number of documents of each class per feature."""
    total = np.zeros((2, DIM), dtype=np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy()
        for first, group in words.blocks(batch.column(1).to_pylist()):
            f, bounds = feature_sets(group)
            own = np.repeat(label[first:first + len(group)], np.diff(bounds))
            for c in (0, 1):
                total[c] += np.bincount(f[own == c], minlength=DIM)
    rows = slices_of(total[0], 0) + slices_of(total[1], 1)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary())], names=["kind", "slice", "data"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, group in words.blocks(batch.column(1).to_pylist()):
            f, bounds = feature_sets(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(group)),
                 pa.array([f[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["label", "features"])


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """``log((p / |p|) / (q / |q|))`` with one added to every count; row 1 is the positive class."""
    q, p = counts[0] + 1.0, counts[1] + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_dual(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model by dual coordinate descent:
    one dual variable per row in ``[0, COST]``, visited in random order."""
    w = np.zeros(DIM + 1)
    alpha = np.zeros(len(rows))
    y = np.where(labels == 1, 1.0, -1.0)
    x = []
    for f in rows:
        v = ratio[f]
        norm = np.sqrt(v @ v)
        x.append(v / norm if norm else v)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], x[i]
            gradient = y[i] * (w[f] @ v + w[DIM]) - 1.0
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                w[DIM] += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def fit(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> dict[str, np.ndarray]:
    """Log-count ratios from all rows of ``labelled`` (``id, label``), weights from at most
    ``FIT_ROWS`` of them: all, or those whose hashed id lies in the share of the hash range that
    is expected to hold 97 per cent of ``FIT_ROWS``. Rows with a null id or a label other than 0 and 1 are not used; a
    class without rows leaves a model that always says the other one (1 if there are none)."""
    lab = labelled.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"),
        F.xxhash64(F.col(id_col).cast("bigint")).alias("_h"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.col(id_col).cast("bigint")).alias("_h"))
    some = maybe_among(texts, "_h", lab).drop("_h")
    joined = stored(some.join(lab, "doc_id").select("label", "text", "_h"), "labelled")
    counts = summed(joined.select("label", "text").mapInArrow(_class_counts, SLICE_SCHEMA), 2, DIM)
    # chosen by hash where the rows lie: no text is moved or ordered for it
    n = joined.count()
    cut = (1 << 63) - 1 if n <= FIT_ROWS else int(0.97 * FIT_ROWS / n * (1 << 64)) - (1 << 63)
    sample = joined.filter(F.col("_h") <= cut).select("label", "text").mapInArrow(
        _features, "label int, features binary").limit(FIT_ROWS).toArrow()
    rows = [np.frombuffer(f.as_buffer(), np.int32) for f in sample["features"]]
    label = sample["label"].to_numpy().astype(np.int64)
    del sample
    ratio = log_count_ratios(counts)
    if len(set(label.tolist())) < 2:
        w = np.zeros(DIM + 1)
        w[DIM] = -1.0 if len(label) and label[0] == 0 else 1.0
        return {"ratio": ratio, "weight": w}
    return {"ratio": ratio, "weight": fit_dual(rows, label, ratio)}


def _scores(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], text: int,
            names: list[str]) -> Iterator[pa.RecordBatch]:
    ratio, w = model["ratio"], model["weight"]
    square, product = ratio * ratio, ratio * w[:DIM]
    for batch in batches:
        score = np.empty(batch.num_rows)
        for first, group in words.blocks(batch.column(text).to_pylist()):
            f, bounds = feature_sets(group)
            total = np.concatenate(([0.0], np.cumsum(product[f])))
            norm = np.concatenate(([0.0], np.cumsum(square[f])))
            total, norm = (c[bounds[1:]] - c[bounds[:-1]] for c in (total, norm))
            margin = total / np.sqrt(np.where(norm > 0, norm, 1.0)) + w[DIM]
            score[first:first + len(group)] = 1 / (1 + np.exp(-np.clip(SLOPE * margin, -700, 700)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=names)


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text",
                  score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text: 0 to 1, higher means label 1 likelier.

    Defined cases: null and empty texts have no features and get the score of the bias alone;
    rows are scored one by one, so repeated rows get equal scores; all other columns are
    passed through (``score_col`` must not exist). An empty table gives an empty result.
    """
    if score_col in docs.columns:
        raise ValueError(f"column {score_col!r} exists already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, names = docs.columns.index(text_col), [*docs.columns, score_col]
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.mapInArrow(lambda it: _scores(it, shared.value, text, names), schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 3, is 1 (a null id is not)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
