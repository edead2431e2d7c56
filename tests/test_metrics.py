"""Metrics, label profiling, run-log operators, names."""

import math

import pytest
from pyspark.sql import functions as F

from seqlake.functions.names import sanitize_name
from seqlake.operators import labels as LB
from seqlake.operators import metrics as M
from seqlake.operators import runlog as RL
from seqlake.operators.prefix import running_total, top_k


def _brute_auc(rows):
    pos = [s for s, y in rows if y > 0]
    neg = [s for s, y in rows if y <= 0]
    if not pos or not neg:
        return float("nan")
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_matches_brute_force_with_ties_and_buckets(spark):
    rows = [(g, float((i * 37) % 23), int((i * 11) % 7 < 3)) for g in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for buckets in (1, 4, 16):
        got = {r.g: r.roc_auc for r in M.roc_auc(df, ["g"], buckets=buckets).collect()}
        for g in ("a", "b"):
            want = _brute_auc([(s, y) for gg, s, y in rows if gg == g])
            assert got[g] == pytest.approx(want)


def test_roc_auc_flips_under_negation_and_single_class_is_nan(spark):
    rows = [(float(i % 13), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, label int").withColumn("g", F.lit(1))
    a = M.roc_auc(df, ["g"]).first().roc_auc
    b = M.roc_auc(df.withColumn("score", -F.col("score")), ["g"]).first().roc_auc
    assert a + b == pytest.approx(1.0)
    one = M.roc_auc(df.filter(F.col("label") == 1), ["g"]).first().roc_auc
    assert math.isnan(one)


def test_classification_metrics_and_zero_denominators(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (1, 1), (0, 1)]
    df = spark.createDataFrame(rows, "label int, pred int").withColumn("g", F.lit(1))
    r = M.classification_metrics(df, ["g"]).first()
    tp, fp, tn, fn = 2, 1, 2, 1
    assert r.accuracy == pytest.approx(4 / 6)
    assert r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert r.mcc == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    assert (r.n_samples, r.n_positive) == (6, 3)
    z = M.classification_metrics(df.withColumn("pred", F.lit(0)).withColumn("label", F.lit(0)), ["g"]).first()
    assert (z.mcc, z.f1, z.accuracy) == (0.0, 0.0, 1.0)


def test_compare_results_keeps_random_rows_and_multiplies_duplicates(spark):
    sch = "task_name string, model string, split string, metric string, value double"
    r = spark.createDataFrame([("t", "m", "test", "f1", 0.1), ("t", "m", "test", "mcc", 0.2)], sch)
    e = spark.createDataFrame([("t", "m", "test", "f1", 0.3)], sch)
    t = spark.createDataFrame([("t", "m", "test", "f1", 0.5), ("t", "m", "test", "f1", 0.6)], sch)
    out = M.compare_results(r, e, t).collect()
    assert len(out) == 3
    assert sorted((x.metric, x.experiment, x.teacher) for x in out)[0] == ("f1", 0.3, 0.5)
    assert [x for x in out if x.metric == "mcc"][0].experiment is None


def test_label_profile_and_gate(spark):
    rows = [("a", "train", 0), ("a", "train", 1), ("a", "test", 1), ("b", "train", 1),
            ("c", "train", 0), ("c", "train", 1), ("c", "train", 2)]
    df = spark.createDataFrame(rows, "task_name string, split string, label int")
    gate = {r.task_name: r.status for r in LB.label_gate(df).collect()}
    assert gate == {"a": "ok", "b": "skip", "c": "error"}
    uniq = {(r.task_name, r.split): r.labels for r in LB.label_unique(df).collect()}
    assert uniq[("c", "train")] == [0, 1, 2]
    fr = {(r.task_name, r.split, r.label): r.proportion for r in LB.label_frequencies(df).collect()}
    assert fr[("a", "train", 0)] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        LB.label_null_check(df.withColumn("label", F.lit(None).cast("int")), strict=True)


def test_max_pool(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0], [0.0, 9.0]],)], "s array<array<double>>")
    assert df.select(LB.max_pool(F.col("s"))).first()[0] == [3.0, 9.0]


def test_running_total_and_top_k_are_exact(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                     (F.col("id") % 7).alias("v"))
    got = {(r.g, r.o): r.rt for r in running_total(df, ["g"], "o", "v", "rt", buckets=8).collect()}
    acc = {}
    for o in range(2000):
        g = o % 3
        acc[g] = acc.get(g, 0) + o % 7
        assert got[(g, o)] == acc[g]
    tk = top_k(df, ["g"], [F.col("v").desc(), "o"], 5, salt_buckets=4).collect()
    for g in range(3):
        want = sorted([(-(o % 7), o) for o in range(2000) if o % 3 == g])[:5]
        assert sorted((-(r.v), r.o) for r in tk if r.g == g) == want


@pytest.mark.parametrize("dense", [True, False])
def test_first_per_step_matches_sequential_rule(spark, dense):
    steps = [0, 0, 1, 1, 1, 2, 4, 4, 3, 5, 6, 6, 10, 10]
    gap = 1 if dense else 3   # non-dense: batch counters with gaps, two runs interleaved
    rows = [("r", i * gap, s, 0.0) for i, s in enumerate(steps)]
    if not dense:
        rows += [("q", i * gap + 1, s, 0.0) for i, s in enumerate(reversed(steps))]
    df = spark.createDataFrame(rows, "run string, batch_idx long, step long, loss double")
    sched = spark.createDataFrame([(s,) for s in (1, 3, 4, 6, 10)], "step long")
    got = sorted((r.run, r.batch_idx) for r in RL.first_per_step(df, sched, dense=dense).collect())
    want = []
    for run in sorted({r[0] for r in rows}):
        last = -1
        for _, b, s, _ in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if s in (1, 3, 4, 6, 10) and last < s:
                want.append((run, b))
            last = s
    assert got == sorted(want)


def test_parameter_label(spark):
    from seqlake.constants import EMBEDDING_PARAM_MARKER, SIGNIFICANT_PARAM_SUFFIXES, SUBMODULE_PREFIX
    from seqlake.plans.fixtures import PARAM_NAMES
    df = spark.createDataFrame([(n,) for n in PARAM_NAMES], "name string")
    got = {r.name: r.label for r in df.select(
        "name", RL.parameter_label(F.col("name"), SIGNIFICANT_PARAM_SUFFIXES, EMBEDDING_PARAM_MARKER,
                                   SUBMODULE_PREFIX).alias("label")).collect()}
    assert got[PARAM_NAMES[0]] == "diag/L0/mamba_fwd.in_proj.weight"
    assert got[PARAM_NAMES[4]] == "diag/L14/mamba_rev.x_proj.weight"
    assert got[PARAM_NAMES[6]] == "diag/embed"
    assert got[PARAM_NAMES[7]] is None and got[PARAM_NAMES[8]] is None and got[PARAM_NAMES[9]] is None


@pytest.mark.parametrize("name,strict,loose", [
    ("9abc", "f_9abc", "9abc"), ("class", "f_class", "class"), ("/x/y/", "f_x_y", "_x_y"),
    ("gs://a/b.ckpt", "gs_a_b_ckpt", "gs_a_b_ckpt"), ("Hello World!!", "hello_world", "hello_world"),
    ("---", None, None)])
def test_sanitize_name(spark, name, strict, loose):
    df = spark.createDataFrame([(name,)], "n string")
    r = df.select(sanitize_name(F.col("n"), True).alias("s"), sanitize_name(F.col("n"), False).alias("l")).first()
    assert (r.s, r.l) == (strict, loose)


def test_sanitize_name_raises_on_empty(spark):
    df = spark.createDataFrame([("---",)], "n string")
    with pytest.raises(Exception):
        df.select(sanitize_name(F.col("n"), on_empty="raise")).collect()


def test_roc_auc_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(2000).selectExpr("id % 3 AS g", "(id * 7919) % 501 AS score", "CAST(id % 2 AS int) AS label",
                                      "CAST(id % 5 = 0 AS int) AS pred").repartition(4)
    df = df.mapInArrow(counted, df.schema)
    M.evaluate(df, ["g"]).collect()
    assert read.value == 2000


def test_evaluate_equals_its_parts(spark):
    df = spark.range(500).selectExpr("nullif(id % 3, 0) AS g", "CAST((id * 37) % 23 AS double) AS score",
                                     "CAST(id % 7 < 3 AS int) AS label", "CAST(id % 5 = 0 AS int) AS pred")
    rows = {r.g: r for r in M.evaluate(df, ["g"]).collect()}
    auc = {r.g: r.roc_auc for r in M.roc_auc(df, ["g"]).collect()}
    rest = {r.g: r for r in M.classification_metrics(df, ["g"]).collect()}
    assert set(rows) == {None, 1, 2}
    for g, r in rows.items():
        assert r.roc_auc == pytest.approx(auc[g])
        assert all(r[m] == pytest.approx(rest[g][m]) for m in ("mcc", "accuracy", "f1", "n_samples", "n_positive"))


def test_running_total_over_strings_and_one_large_group(spark):
    df = spark.range(3000).selectExpr("'a' AS g", "lpad(CAST(id AS string), 6, '0') AS o", "id AS v")
    got = {r.o: r.t for r in running_total(df, ["g"], "o", "v", "t", buckets=16).collect()}
    assert all(got[f"{i:06d}"] == i * (i + 1) // 2 for i in range(3000))
    plan = running_total(df, ["g"], "o", "v", "t", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def _features(spark, rows):
    return spark.createDataFrame(rows, "task_name string, split string, sample_id int, feature array<double>, "
                                       "label int, error string")


def test_task_outcomes_roll_back_whole_tasks(spark):
    ok = [("a", s, i, [1.0, 2.0], 1, None) for i, s in enumerate(("train", "test", "train"))]
    bad = [("b", "train", 1, [1.0, 2.0], 1, None), ("b", "test", 2, None, 1, "too long"),
           ("c", "train", 1, [1.0], 1, None), ("c", "test", 2, [1.0, 2.0], 0, None),
           ("d", "train", 1, [1.0], 1, None), ("e", "train", 1, None, 1, None), ("f", "test", 9, [1.0], 1, None)]
    parts = [_features(spark, ok), _features(spark, bad)]
    listed = spark.createDataFrame([(t,) for t in "abcdeg"], "task_name string")
    kept, out = LB.concat_tasks(parts, listed)
    assert {r.sample_id for r in kept.collect()} == {0, 1, 2} and "error" not in kept.columns
    got = {r.task_name: (r.status, r.n_samples, r.n_failed, r.detail) for r in out.collect()}
    assert got == {"a": ("ok", 3, 0, None), "b": ("failed", 2, 1, "too long"), "c": ("failed", 2, 0, "ragged"),
                   "d": ("empty", 1, 0, "test"), "e": ("failed", 1, 1, "no feature"),
                   "g": ("empty", 0, 0, "train,test")}


def test_label_gate_reaches_every_branch(spark):
    rows = [("one", "train", 0), ("one", "train", 1), ("three", "train", 0), ("three", "train", 1),
            ("three", "train", 2), ("single", "train", 1), ("single", "test", 0)]
    df = spark.createDataFrame(rows, "task_name string, split string, label int")
    listed = spark.createDataFrame([(t,) for t in ("one", "three", "single", "none")], "task_name string")
    got = {r.task_name: r.status for r in LB.label_gate(df, listed).collect()}
    assert got == {"one": "ok", "three": "error", "single": "skip", "none": "error"}
    whole = LB.label_gate(df.filter("task_name = 'one'"), listed.filter("task_name IN ('one', 'none')"))
    assert {r.task_name: r.status for r in whole.collect()} == {"one": "error", "none": "error"}


def test_block_pooling_equals_pooling_of_the_whole(spark):
    t, d = 37, 5
    states = [[float((i * 31 + j * 17) % 101) for j in range(d)] for i in range(t)]
    blocks = [(1, b, [x for row in states[b * 8:b * 8 + 8] for x in row]) for b in range(5)]
    blocks += [(2, 0, [None, 3.0, None, 1.0, 2.0, None, 4.0, None, 0.0, 9.0]), (3, 0, [])]
    df = spark.createDataFrame(blocks, "sample int, block int, states array<double>")
    got = {(r.sample, r.dim): r.value for r in LB.max_pool_blocks(df, ["sample"], d).collect()}
    want = {(1, j): max(row[j] for row in states) for j in range(d)}
    want |= {(2, 0): None, (2, 1): 4.0, (2, 2): None, (2, 3): 1.0, (2, 4): 9.0}
    assert got == want
    with pytest.raises(Exception, match="no multiple of 5"):
        LB.max_pool_blocks(spark.createDataFrame([(1, [1.0] * 7)], "sample int, states array<double>"), ["sample"], d).collect()
