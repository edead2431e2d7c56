"""Plan shape: pruning, pushdown, exchanges."""

from seqlake.operators import losses as L
from seqlake.plans.fixtures import lineitem_positions

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loss_reads_only_needed_columns_and_shuffles_once(spark):
    df = L.distillation_loss(lineitem_positions(spark, SF_SMALL), ["batch_id"], 4.0, 0.8, 0.0, 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "l_returnflag" not in plan and "l_shipdate" not in plan
    assert "NestedLoop" not in plan


def test_dual_report_is_one_aggregation(spark):
    from seqlake.plans.fixtures import embedding_positions
    df = L.dual_loss_report(embedding_positions(spark, SF_SMALL), ["batch_id"], 4.0, 0.8, 1.0, 16)
    assert _plan(df).count("Exchange") == 1
