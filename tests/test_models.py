"""H1 scoring and H4 probe runs (small, gbrt only)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import probes as PR
from seqlake.plans.fixtures import probe_features, table

from conftest import SF_SMALL


def test_score_batches_matches_numpy(spark):
    w = [((i % 7) - 3) / 10 for i in range(1, 65)]
    e = table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding")
    got = {r.vec_id: r.score for r in PR.score_batches(e, PR.linear_scorer(w), "embedding", 64,
                                                         batch_size=37).collect()}
    for r in e.limit(20).collect():
        assert got[r.vec_id] == pytest.approx(float(np.asarray(r.embedding, dtype=np.float64) @ np.asarray(w)))


def test_run_probes_shape_and_gate(spark):
    f = probe_features(spark, SF_SMALL)
    res = PR.run_probes(f, seed=0, gbrt_only=True, gbrt_iter=5)
    rows = res.collect()
    tasks = {r.task_name for r in f.select("task_name").distinct().collect()}
    assert len(rows) == len(tasks) * 2 * 6
    n = {(r.task_name, r.split): r.value for r in rows if r.metric == "n_samples"}
    for t in tasks:
        assert n[(t, "train")] + n[(t, "test")] == f.filter(F.col("task_name") == t).count()
    bad = f.withColumn("label", F.col("sample_id") % 3)
    with pytest.raises(ValueError):
        PR.run_probes(bad, gbrt_only=True, gbrt_iter=2)


def test_probe_queries_do_the_whole_fit(spark, monkeypatch):
    """The registered queries try ten regularisation strengths and boost 100 rounds."""
    from seqlake.plans import q_models
    asked = []

    class Fitted(Exception):
        pass

    def fit(self, df):
        asked.append(self)
        raise Fitted

    monkeypatch.setattr(PR.CrossValidator, "fit", fit)
    with pytest.raises(Fitted):
        q_models.q_probe_lreg(spark, SF_SMALL)
    monkeypatch.setattr(PR.GBTClassifier, "fit", fit)
    for query in (q_models.q_probe_gbrt, q_models.q_run_probes):
        with pytest.raises(Fitted):
            query(spark, SF_SMALL)
    monkeypatch.setattr(PR, "probe_gbrt", lambda *a: None)
    with pytest.raises(Fitted):
        q_models.q_run_probes(spark, SF_SMALL)
    assert [a.getMaxIter() for a in asked[1:3]] == [100, 100]
    for cv in (asked[0], asked[3]):
        grid = sorted(v for m in cv.getEstimatorParamMaps() for v in m.values())
        assert len(grid) == 10 and grid[-1] / grid[0] == pytest.approx(1e8)


def test_position_store_keeps_ids_and_logits(spark):
    """Rows per (tile, block) with the ids and 5 logits of every position, in the model's own
    batches; position rows come back whole."""
    from seqlake.operators import losses as L
    texts = ["789:;67", "4", "", None, "77887799:", "9999999", "7", "89:4789:4789"]
    seen = []

    def make():
        def predict(x):
            assert len(x) <= 2
            return x[:, :, None] * 10.0 + np.arange(5)
        return predict

    df = spark.createDataFrame(list(enumerate(texts)), "sample bigint, ids string").coalesce(1)
    stored = PR.score_token_positions(df, make, ["sample"], batch_size=2, block=4)
    blocks = {(r.sample, r.block): r for r in stored.collect()}
    for i, t in enumerate(texts):
        x = [ord(c) - 48 for c in t or ""]
        for b in range(max(-(-len(x) // 4), 1)):
            r = blocks.pop((i, b))
            assert r.input_ids == x[4 * b:4 * b + 4]
            assert r.logits == [v * 10.0 + j for v in r.input_ids for j in range(5)]
            seen += [(i, 4 * b + p, v, v * 10.0, v * 10.0 + 4) for p, v in enumerate(r.input_ids)]
    assert not blocks
    pos = L.block_positions(stored, {"s": "logits"}, block=4).collect()
    assert sorted((r.sample, r.pos, r.tok, r.s_c4, r.s_c7) for r in pos) == sorted(seen)


def test_workflow_stores_hold_positions(spark, monkeypatch):
    from seqlake.plans import q_workflows as W
    kept = []
    append = W.DS.append_soft_labels
    monkeypatch.setattr(W.DS, "append_soft_labels", lambda df, path, key: (kept.append(path), append(df, path, key)))
    W.q_soft_label_generation(spark, SF_SMALL)
    W.q_validation_report(spark, SF_SMALL)
    assert len(kept) == 3
    for path in kept:
        r = W.DS.read_soft_labels(spark, path, W.BLOCK_KEY).selectExpr(
            "count(*) n", "count(DISTINCT sample, block) k", "min(5 * size(input_ids) = size(logits)) ok").first()
        assert r.n == r.k > 0 and r.ok
