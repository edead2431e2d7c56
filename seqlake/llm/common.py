"""Helpers of the corpus operators: intermediate tables in the shared folder, a bounded
membership filter, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.session import ensure_scratch, scratch_path, ship_package

FILTER_BITS = 1 << 25          # size of the membership filter: 4 MB whatever the data
BATCH_BYTES = 4 << 20          # of an Arrow batch, beyond which it takes no more rows
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"    # Spark's own value of it


def prepare(spark: SparkSession) -> None:
    """Scratch folder, code for the workers, and Arrow batches of ``BATCH_BYTES`` unless the
    session sets its own size: texts differ in length by a factor of 10,000, so a number of
    rows bounds no memory."""
    ensure_scratch(spark)
    ship_package(spark)
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: lineage is cut,
    and a lost executor costs no more than the tasks that were running. Shuffle files of the
    finished jobs are released as soon as the driver drops its references to them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(doc_id: str, text: str) -> Column:
    """A document is its id and its text: 64-bit key, never null."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def flag_among(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean column ``flag``: false only if ``key`` (a well mixed 64-bit
    number) is surely not among ``keys[key]``.

    The filter behind it has ``FILTER_BITS`` bits, at most ``FILTER_BITS / 64`` rows to
    broadcast, at any size; the fuller it is, the more other rows it flags.
    """
    word, bits = fresh(df, "_word"), fresh(df, "_bits")
    slot = F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1))
    marks = keys.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias(word)).agg(
        F.expr("bit_or(shiftleft(1L, CAST(_slot & 63 AS INT)))").alias(bits))
    out = df.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(marks), word, "left")
    hit = F.getbit(F.coalesce(F.col(bits), F.lit(0).cast("bigint")), F.col(key).bitwiseAND(F.lit(63))) == 1
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(word, bits)


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys[key]``: every row that is stays, some
    others do too, so an exact join has to follow (see :func:`flag_among`)."""
    flag = fresh(df, "_maybe")
    return flag_among(df, key, keys, flag).filter(F.col(flag)).drop(flag)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every vertex of the undirected graph ``edges``; the component is
    its smallest vertex. Alternates large-star and small-star rounds until every component is
    a star around its smallest vertex (logarithmically many rounds). All minima are partial
    aggregates; each round is a table in the shared folder."""
    links = stored(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
                   .filter("v <> u").distinct(), "links")
    while True:
        both = links.selectExpr("v AS x", "u AS y").unionAll(links.selectExpr("u AS x", "v AS y"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) AS m")
        large = both.join(low, "x").filter("y > x").selectExpr("y AS v", "m AS u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u <> m").selectExpr("u AS v", "m AS u")
        links = stored(small.unionAll(low.selectExpr("v", "m AS u")).distinct(), "links")
        several = links.groupBy("v").count().filter("count > 1").isEmpty()
        if several and links.join(links.selectExpr("u AS v").distinct(), "v", "left_semi").isEmpty():
            break
    return links.selectExpr("v AS id", "u AS component").unionAll(
        links.selectExpr("u AS id", "u AS component").distinct())


SLICE = 2048                   # counters per slice of a summed vector


def slices_of(vector, kind: int = 0) -> list[tuple[int, int, bytes]]:
    """The non-zero entries of an integer vector, ``SLICE`` entries to a row
    ``(kind, slice, data)``: 16-bit places followed by 32-bit values."""
    import numpy as np
    at = np.flatnonzero(vector)
    part = at // SLICE
    cut = np.searchsorted(part, np.arange(part[-1] + 2)) if len(at) else np.zeros(1, np.int64)
    out = []
    for s in range(len(cut) - 1):
        i = at[cut[s]:cut[s + 1]]
        if len(i):
            out.append((kind, s, (i % SLICE).astype(np.uint16).tobytes()
                        + vector[i].astype(np.uint32).tobytes()))
    return out


def _add_slices(batches, kind_of_number: str):
    import numpy as np
    import pyarrow as pa
    most = np.iinfo(kind_of_number).max
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, s, data in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(data) // 6
            v = total.setdefault((kind, s), np.zeros(SLICE, dtype=np.int64))
            v[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.uint32, n, 2 * n)
    names = list(total)
    for at in range(0, len(names), 64):         # small batches: the receiver holds one at a time
        part = names[at:at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.int32()), pa.array([s for _, s in part], pa.int32()),
             pa.array([np.minimum(total.pop(k), most).astype(kind_of_number).tobytes() for k in part],
                      pa.binary())], names=["kind", "slice", "data"])


SLICE_SCHEMA = "kind int, slice int, data binary"


def summed(parts: DataFrame, kinds: int, size: int, numbers: str = "int64"):
    """Sum of the vectors whose slices ``parts`` holds (``SLICE_SCHEMA``): one array of
    ``size`` per kind, of the numpy type ``numbers`` (larger sums become its largest number).
    Slices are added up by the executors; the driver gets ``kinds * size`` numbers, a bound
    that the caller sets and that does not depend on the data."""
    import numpy as np
    out = np.zeros((kinds, size), dtype=numbers)
    rows = parts.repartition("kind", "slice").mapInArrow(lambda it: _add_slices(it, numbers), SLICE_SCHEMA)
    for batch in rows.toArrow().to_batches():
        for kind, s, data in zip(*batch.columns):
            s = s.as_py()
            out[kind.as_py(), s * SLICE:(s + 1) * SLICE] = np.frombuffer(data.as_buffer(), numbers)
    return out
