"""Stores: idempotent append, read-through, results CSV."""

import pytest
from pyspark.sql import functions as F

from seqlake.session import scratch_path
from seqlake.sources import delta_store as DS
from seqlake.sources import stores as ST

KEY = ["sample", "block"]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "sample bigint, block int, batch_idx bigint, v double")


def _read(spark, path, order=()):
    return sorted(tuple(r) for r in DS.read_soft_labels(spark, path, KEY, order).collect())


def test_append_twice_equals_append_once(spark):
    df = spark.range(0, 300).select(F.col("id").alias("sample"), (F.col("id") / 50).cast("long")
                                    .alias("batch_idx"), (F.col("id") * 0.5).alias("score"))
    path = scratch_path(spark, "store-test")
    for part in (df.filter(F.col("sample") % 3 == 0), df, df.filter(F.col("batch_idx") == 2)):
        assert DS.append_soft_labels(part, path, ["sample"])
    back = DS.read_soft_labels(spark, path, ["sample"])
    assert back.count() == 300 and back.columns == df.columns
    assert back.select("sample").distinct().count() == 300


def test_blocks_of_a_sample_are_rows_of_their_own(spark):
    path = scratch_path(spark, "store-blocks")
    DS.append_soft_labels(_rows(spark, [(1, b, 0, 1.0 * b) for b in range(3)]), path, KEY)
    assert len(_read(spark, path)) == 3
    with pytest.raises(ValueError, match="key columns"):
        DS.append_soft_labels(_rows(spark, []), path, ["sample", "position"])
    with pytest.raises(TypeError):
        DS.append_soft_labels(_rows(spark, []), path)


def test_last_writer_wins_and_repeated_keys_inside_a_commit(spark):
    path = scratch_path(spark, "store-order")
    DS.append_soft_labels(_rows(spark, [(1, 0, 9, 1.0), (1, 1, 0, 1.0), (None, 0, 0, 1.0)]), path, KEY)
    DS.append_soft_labels(_rows(spark, [(1, 0, 4, 2.0), (1, 0, 5, 3.0), (None, 0, 1, 4.0)]).repartition(3), path, KEY)
    want = [(1, 0, 5, 3.0), (1, 1, 0, 1.0), (None, 0, 1, 4.0)]
    got = DS.read_soft_labels(spark, path, KEY, ["batch_idx"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_append_reads_nothing_and_shuffles_nothing(spark, monkeypatch):
    path, seen = scratch_path(spark, "store-plain"), []
    first = _rows(spark, [(i, 0, 0, 1.0) for i in range(50)])
    DS.append_soft_labels(first, path, KEY)
    monkeypatch.setattr(DS, "stored_rows", lambda *a: seen.append(a))
    monkeypatch.setattr(DS, "conflicts", lambda *a: seen.append(a))
    DS.append_soft_labels(first, path, KEY)
    assert not seen
    # even if every stored row were gone, an append would go through
    monkeypatch.undo()
    before = {r.folder for r in DS.commits(spark, path).collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in before:
        p = hadoop(f"{path}/data/{folder}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    assert DS.append_soft_labels(first, path, KEY)


def test_replay_writes_nothing(spark):
    path = scratch_path(spark, "store-replay")
    assert DS.append_soft_labels(_rows(spark, [(1, 0, 0, 1.0)]), path, KEY, commit="epoch 0")
    assert not DS.append_soft_labels(_rows(spark, [(1, 0, 0, 7.0)]), path, KEY, commit="epoch 0")
    assert _read(spark, path) == [(1, 0, 0, 1.0)]


def test_crash_between_data_and_commit(spark, monkeypatch):
    path = scratch_path(spark, "store-crash")
    DS.append_soft_labels(_rows(spark, [(1, 0, 0, 1.0), (2, 0, 0, 1.0)]), path, KEY, commit="a")

    def die(*_):
        raise RuntimeError("lost the driver")

    for act in (lambda: DS.append_soft_labels(_rows(spark, [(1, 0, 1, 2.0), (3, 0, 1, 2.0)]), path, KEY, commit="b"),
                lambda: DS.compact(spark, path, KEY)):
        with monkeypatch.context() as m:
            m.setattr(DS, "_finish", die)
            with pytest.raises(RuntimeError):
                act()
        assert _read(spark, path) == [(1, 0, 0, 1.0), (2, 0, 0, 1.0)]
    assert DS.append_soft_labels(_rows(spark, [(1, 0, 1, 2.0), (3, 0, 1, 2.0)]), path, KEY, commit="b")
    want = [(1, 0, 1, 2.0), (2, 0, 0, 1.0), (3, 0, 1, 2.0)]
    assert _read(spark, path) == want
    assert len(DS.vacuum(spark, path)) == 2           # what the two dead jobs left
    assert _read(spark, path) == want


def test_compaction_keeps_rows_and_order(spark):
    path = scratch_path(spark, "store-compact")
    for v in range(3):
        DS.append_soft_labels(_rows(spark, [(i, 0, v, float(v)) for i in range(v, 6)]), path, KEY, commit=f"c{v}")
    want = [(i, 0, min(i, 2), float(min(i, 2))) for i in range(6)]
    assert _read(spark, path) == want
    DS.compact(spark, path, KEY)
    assert _read(spark, path) == want and len(DS.vacuum(spark, path)) == 3
    assert _read(spark, path) == want
    assert not DS.append_soft_labels(_rows(spark, [(0, 0, 9, 9.0)]), path, KEY, commit="c1")   # still known
    DS.append_soft_labels(_rows(spark, [(5, 0, 9, 9.0)]), path, KEY)
    DS.compact(spark, path, KEY)
    assert _read(spark, path) == want[:5] + [(5, 0, 9, 9.0)]


def test_store_without_conflicts_is_a_plain_scan(spark):
    path = scratch_path(spark, "store-scan")
    for v in range(2):
        DS.append_soft_labels(_rows(spark, [(v, 0, v, 1.0)]), path, KEY)
    plan = DS.read_soft_labels(spark, path, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="columns"):
        DS.append_soft_labels(spark.range(3).withColumn("block", F.lit(1)).withColumnRenamed("id", "sample"), path, KEY)
    with pytest.raises(ValueError, match="no finished commit"):
        DS.read_soft_labels(spark, scratch_path(spark, "no-store"), KEY)


def test_read_through_builds_once(spark):
    path = scratch_path(spark, "rt-test")
    calls = []

    def build():
        calls.append(1)
        return spark.range(0, 10)

    assert ST.read_through(spark, path, build).count() == 10
    assert ST.read_through(spark, path, build).count() == 10
    assert len(calls) == 1


def test_results_csv_roundtrip(spark):
    rows = [("t", "m", "test", "f1", 0.25), ("t", "m", "train", "roc_auc", float("nan"))]
    df = spark.createDataFrame(rows, ST.RESULTS_SCHEMA)
    path = scratch_path(spark, "res-test")
    ST.write_results(df, path)
    back = ST.read_results(spark, path)
    assert back.schema == ST.RESULTS_SCHEMA
    assert back.count() == 2


def test_bucketed_stores_join_without_a_shuffle(spark):
    tables = []
    for v in (1.0, 2.0):
        path = scratch_path(spark, "store-bucketed")
        for part in range(2):       # the second append replaces half of the first
            DS.append_soft_labels(_rows(spark, [(i, b, part, v + part) for i in range(0, 40, 1 + part)
                                                for b in range(2)]), path, KEY)
        tables.append(DS.bucketed(spark, path, KEY, buckets=4))
    joined = tables[0].alias("x").hint("merge").join(tables[1].alias("y"), KEY)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = joined.select("sample", "block", "x.v", "y.v").collect()
    assert sorted(map(tuple, rows)) == [(i, b, 2.0 - i % 2, 3.0 - i % 2) for i in range(40) for b in range(2)]


def test_fingerprint_follows_the_data(spark):
    path = scratch_path(spark, "fp")
    spark.range(0, 5).coalesce(1).write.parquet(path)
    a = ST.source_fingerprint(spark, path)
    assert a == ST.source_fingerprint(spark, path)
    spark.range(5, 6).coalesce(1).write.mode("append").parquet(path)
    b = ST.source_fingerprint(spark, path)
    spark.range(0, 5).coalesce(1).write.mode("overwrite").parquet(path)
    assert len({a, b, ST.source_fingerprint(spark, path)}) == 3


def test_changed_table_rebuilds_what_is_derived(spark, tmp_path):
    from seqlake.plans.fixtures import contig_length_table

    def write(text):
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.mode("overwrite") \
            .parquet(f"{tmp_path}/documents.parquet")

    for text in ("ACGT", "ACGTACGT"):
        write(text)
        assert [r.length for r in contig_length_table(spark, str(tmp_path)).collect()] == [len(text)]
