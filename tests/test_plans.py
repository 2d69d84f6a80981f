"""Physical-plan properties the design relies on."""

from paths import SF01
from specsheet.plans.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_limits_before_shuffle(spark):
    for name in ("fastest_per_category", "similar_items"):
        p = _plan(QUERIES[name](spark, SF01))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_similarity_broadcasts_only_targets(spark):
    p = _plan(QUERIES["similar_items"](spark, SF01))
    assert "BroadcastNestedLoopJoin" in p and "CartesianProduct" not in p


def test_filters_and_pruning_reach_scan(spark):
    df = QUERIES["browse"](spark, SF01)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in s and "EqualTo(Company_Clean,FERRARI)" in s
    p = _plan(QUERIES["brand_box"](spark, SF01))
    assert "In(Company_Clean" in p


def test_exact_quantile_passes(spark):
    """Sketch, refinement and collapse at every size; the plain aggregates ride along."""
    from specsheet.functions.stats import quantiles
    p = _plan(QUERIES["by_brand"](spark, SF01))
    assert p.count("Scan parquet") == 3
    from specsheet.sources.tables import read_table
    li = read_table(spark, SF01, "lineitem")
    assert _plan(quantiles(li, "l_quantity", [0.5])).count("Scan parquet") == 3
