"""A4: the soft-label store, a Parquet table that only ever grows by commits.

A store folder holds ``data/<commit>/`` (Parquet files of one append each) and ``commits/``
(one JSON row per finished append). An append writes its rows to a new data folder and then its
commit row; it reads and shuffles no row, stored or sent. What has no commit row does not exist
for readers, so a job that dies between the two writes leaves nothing behind but files that
:func:`vacuum` removes.

* **Replay.** An append under the name of a commit that is there already does nothing, so a
  rerun batch or a micro-batch that is replayed from its checkpoint cannot double its rows.
* **Last writer wins.** Keys sent again are resolved when the store is read: one pass over the
  key columns alone finds the keys that occur more than once, and only if there are any the
  rows are joined with them (a join of the size of the conflicts, broadcast if they are few).
* **Compaction** (:func:`compact`) is a job of its own: it writes the resolved rows as a new
  commit that stands for all before it. Readers that listed the old commits go on reading them
  until :func:`vacuum` is run.

Commits are ordered by a running number that the writer takes from the commit rows, so a store
has one writer (and one compaction) at a time; readers need no coordination.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.session import scratch_path

_COMMIT = "name string, seq bigint, folder string, through bigint, columns string"
_RESERVED = ("_folder", "_place", "_last", "_n")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, folder, through, columns`` of every finished commit. ``through`` is set for
    compactions: the number of the last commit that they stand for."""
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _COMMIT)


def _live(spark: SparkSession, path: str) -> list:
    """The commit rows that make up the store (one per append since the last compaction)."""
    rows = commits(spark, path).collect()
    through = max((r.through for r in rows if r.through is not None), default=-1)
    return sorted((r for r in rows if (r.seq > through if r.through is None else r.through == through)),
                  key=lambda r: r.folder)


def _write(df: DataFrame, path: str, name: str, number: int, seq: int, through: int | None) -> None:
    folder = f"{number:012d}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/data/{folder}")
    _finish(df.sparkSession, path, (name, seq, folder, through, _columns(df)))


def _finish(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def _columns(df: DataFrame) -> str:
    return ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))


def append_soft_labels(df: DataFrame, path: str, key: Sequence[str], commit: str | None = None) -> bool:
    """Appends the rows of ``df`` as one commit; False if a commit named ``commit`` is there
    already. ``key`` are the columns that name a row (all of them: a sample that is stored in
    blocks needs its block number, too); they are checked here and used when the store is read.
    All appends must have the same columns. Null parts of a key are values like others.

    The work is one write of ``df``: nothing stored is read and nothing is shuffled.
    """
    spark, missing = df.sparkSession, [c for c in key if c not in df.columns]
    if missing or not key:
        raise ValueError(f"key columns {missing or list(key)} are not among {df.columns}")
    if taken := [c for c in df.columns if c in _RESERVED]:
        raise ValueError(f"column names {taken} are taken by the store")
    done = commits(spark, path).filter("through IS NULL").select("name", "seq", "columns").collect()
    if commit is not None and any(r.name == commit for r in done):
        return False
    if other := next((r.columns for r in done if r.columns != _columns(df)), None):
        raise ValueError(f"the store has the columns {other}, sent were {_columns(df)}")
    seq = max((r.seq for r in done), default=-1) + 1
    _write(df, path, commit or uuid.uuid4().hex, seq, seq, None)
    return True


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows, repeated keys included, with ``_folder`` (commits in order) and
    ``_place`` (where the row lies)."""
    live = _live(spark, path)
    if not live:
        raise ValueError(f"{path} has no finished commit")
    rows = spark.read.parquet(*[f"{path}/data/{r.folder}" for r in live])
    file = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(file, r"data/([^/]+)/", 1).alias("_folder"), F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place"))


def conflicts(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The keys stored more than once, with the row that wins (``_last``): the one of the last
    commit, inside a commit the one with the greatest ``order`` columns, then by place."""
    rows, again = stored_rows(spark, path), repeated_keys(spark, path, key)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    last = F.max(F.struct("_folder", *order, "_place")).alias("_last")
    return rows.join(again.select(*[F.col(c).alias(f"_key_{c}") for c in key]), same, "left_semi") \
        .groupBy(*key).agg(last)


def repeated_keys(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The keys stored more than once: a count over the key columns, nothing else is read. They
    are written once and read back, so that both of their uses cost no second count."""
    live = _live(spark, path)
    if not live:
        raise ValueError(f"{path} has no finished commit")
    found = scratch_path(spark, "store-repeats")
    spark.read.parquet(*[f"{path}/data/{r.folder}" for r in live]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n").write.parquet(found)
    return spark.read.parquet(found)


def read_soft_labels(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The store with one row per ``key``, the last written (see :func:`conflicts`).

    The conflicts are found when this is called, by a job that reads key (and ``order``)
    columns only. Without any, the result is a plain scan of the committed files.
    """
    rows = stored_rows(spark, path)
    cols = [c for c in rows.columns if c not in ("_folder", "_place")]
    if repeated_keys(spark, path, key).isEmpty():
        return rows.select(*cols)
    found = scratch_path(spark, "store-conflicts")
    conflicts(spark, path, key, order).write.parquet(found)
    again = spark.read.parquet(found)
    side = again.select(*[F.col(c).alias(f"_key_{c}") for c in key], "_last")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    wins = F.col("_last").isNull() | ((F.col("_last._folder") == F.col("_folder"))
                                      & (F.col("_last._place") == F.col("_place")))
    return rows.join(side, same, "left").filter(wins).select(*cols)


def compact(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ()) -> None:
    """Rewrites the live commits as one, with one row per key and files of even size. Appends
    may follow at once; the old files stay for readers until :func:`vacuum`."""
    through = max(r.seq for r in _live(spark, path))
    rows = read_soft_labels(spark, path, key, order).hint("rebalance")
    _write(rows, path, f"compaction-{uuid.uuid4().hex[:12]}", through, through, through)


def bucketed(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = (),
             buckets: int | None = None) -> DataFrame:
    """The resolved rows as a table bucketed and sorted by ``key``, written next to the store.
    Two stores bucketed alike (default: as many buckets as shuffle partitions) are joined on
    the key without another shuffle, as often as they are needed."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"soft_labels_{uuid.uuid4().hex[:16]}"
    rows = read_soft_labels(spark, path, key, order)
    rows.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).format("parquet") \
        .option("path", f"{path}/bucketed/{name}").saveAsTable(name)
    return spark.table(name)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes data folders that no reader can need any more: those that a compaction stands
    for and those of appends that never finished. Not while an append is running. Returns
    their names."""
    live = {r.folder for r in _live(spark, path)}
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = Path(f"{path}/data")
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in system.listStatus(base) if s.getPath().getName() not in live]
    for p in gone:
        system.delete(p, True)
    return sorted(p.getName() for p in gone)
