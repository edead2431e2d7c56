"""No operator drops, duplicates or misplaces rows on awkward input."""

import pytest

from seqlake.operators import indexing as IX
from seqlake.operators import losses as L
from seqlake.operators import metrics as M
from seqlake.operators import runlog as RL
from seqlake.operators import tiling as TL
from seqlake.sources.delta_store import append_soft_labels, read_soft_labels


def test_append_moves_and_deduplicates(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "sample bigint, batch_idx bigint, v bigint"
    append_soft_labels(spark.createDataFrame([(i, 0, 1) for i in range(10)], schema), path,
                       ["sample"])
    # the same samples under another batch, some of them twice
    append_soft_labels(spark.createDataFrame([(i, 5, 2) for i in range(10)] + [(3, 4, 9)], schema), path,
                       ["sample"])
    rows = read_soft_labels(spark, path, ["sample"], ["batch_idx"]).collect()
    assert sorted((r["sample"], r["batch_idx"], r["v"]) for r in rows) == [(i, 5, 2) for i in range(10)]


def test_resume_then_skip_keeps_the_number_of_rows(spark):
    df = spark.range(10000).withColumnRenamed("id", "idx")
    rest = IX.resume_offset(df, 100, 4, 2)
    out = IX.skip_substitute(rest, [3, 900, 9999, 20000]).collect()
    assert len(out) == 9200 and {r["idx"] for r in out} == set(range(800, 10000))
    assert all(r["source_idx"] not in (900, 9999) and r["source_idx"] >= 800 for r in out)
    gaps = IX.skip_substitute(df.filter("idx % 3 = 0"), [3, 4]).collect()
    assert len(gaps) == 3334 and {r["idx"] for r in gaps} == set(range(0, 10000, 3))


def test_first_per_step_with_a_missing_counter(spark):
    log = spark.createDataFrame([("a", b, 2) for b in (0, 1, 3)], "run string, batch_idx bigint, step bigint")
    sched = spark.createDataFrame([(2,)], "step bigint")
    assert [r["batch_idx"] for r in RL.first_per_step(log, sched).collect()] == [0]


def test_null_groups_and_null_scores(spark):
    rows = [(None, 0.1, 0), (None, 0.9, 1), ("a", 0.2, 1), ("a", 0.8, 0), ("b", None, 1), ("b", 0.3, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for buckets in (1, 8):
        got = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, ["g"], buckets=buckets).collect()}
        assert got[None] == 1.0 and got["a"] == 0.0 and got["b"] != got["b"]
    wide = M.evaluate(df.withColumn("pred", df.label), ["g"]).collect()
    assert {r["g"] for r in wide} == {None, "a", "b"}


def test_null_loss_ranks_last(spark):
    log = spark.createDataFrame([("r", 0, 0, None), ("r", 1, 1, 0.5), ("r", 2, 2, float("nan")), ("r", 3, 3, 0.1)],
                                "run string, batch_idx bigint, step bigint, loss double")
    best = [r for r in RL.best_checkpoints(log, 2).collect() if r["kind"] == "top"]
    assert [(r["rank"], r["loss"]) for r in sorted(best, key=lambda r: r["rank"])] == [(1, 0.1), (2, 0.5)]


def test_schedule_log_reaches_the_last_step(spark):
    log = spark.range(10000)
    steps = sorted(r["step"] for r in RL.schedule_log(log, 1.0, 4).collect())
    assert steps[-1] == 2499 and steps[0] == 10


def test_tile_status_strict(spark):
    tiles = spark.createDataFrame([("c", 0, 4), ("c", -4, 0), ("c", 6, 10), ("x", 0, 4)],
                                  "chr_name string, start bigint, end bigint")
    lens = spark.createDataFrame([("c", 8)], "contig string, length bigint")
    got = {(r["chr_name"], r["start"]): r["status"] for r in TL.tile_status(tiles, lens).collect()}
    assert got == {("c", 0): "ok", ("c", -4): "out_of_bounds", ("c", 6): "out_of_bounds",
                   ("x", 0): "unknown_contig"}
    with pytest.raises(ValueError):
        TL.tile_status(tiles, lens, strict=True)


def test_reject_empty(spark):
    report = spark.createDataFrame([(1, 5), (2, 0)], "batch_id int, n_positions int")
    with pytest.raises(ValueError):
        L.reject_empty(report)
    assert L.reject_empty(report.filter("batch_id = 1")).count() == 1
