"""Physical-plan properties: JVM-only expressions for SQL-checked queries, pruned scans."""

import pytest

from millwright.plans import catalog

catalog.load_all()
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_checked_queries_stay_in_the_jvm(spark, sf, name):
    plan = _plan(catalog.QUERIES[name](spark, sf))
    assert not any(node in plan for node in PYTHON_NODES)


def test_oee_by_line_reads_only_needed_columns(spark, sf):
    plan = _plan(catalog.QUERIES["oee_by_line"](spark, sf))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    for used in ("l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount"):
        assert used in schema
    for unused in ("l_returnflag", "l_extendedprice", "l_orderkey", "l_shipdate"):
        assert unused not in schema


def test_downtime_pareto_partial_aggregation(spark, sf):
    plan = _plan(catalog.QUERIES["downtime_pareto"](spark, sf))
    assert "partial_count" in plan and "partial_sum" in plan


def test_asset_scores_use_no_window_over_the_whole_table(spark, sf):
    for name in ("asset_risk", "minmax_norm", "rule_score"):
        plan = _plan(catalog.QUERIES[name](spark, sf))
        assert "Window" not in plan


def test_trailing_window_is_a_plain_comparison(spark):
    from millwright.functions.common import trailing_window

    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-20", 2), (None, 3)], "d string, v int").selectExpr("cast(d as date) d", "v")
    assert [r["v"] for r in trailing_window(df, "d").collect()] == [2]
    assert [r["v"] for r in trailing_window(df.where("d IS NULL"), "d").collect()] == [3]
    assert "coalesce" not in _plan(trailing_window(df, "d"))
