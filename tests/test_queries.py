"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest

from __spark_entry__ import entry
from query_set import ORACLE, QUERIES
from tools.check_oracle import TABLES, compare

# Queries that end in a tail probability or a fit on a handful of rows, or that call the
# labelling client; nothing else may leave the JVM.
IN_PYTHON = {
    "welch_test", "welch_test_large", "welch_daily_test", "mann_whitney_test", "anova_test", "tukey_test", "pearson_test",
    "spearman_test", "ols_categorical", "ols_numeric", "ols_two", "ols_one_factor", "ols_summary", "ols_many_levels",
    "breusch_pagan", "breusch_pagan_one", "vif", "vif_two", "residuals", "residuals_one",
    "results_json", "result_document", "classify_days", "fact_sheet_lines",
}


# Fits that need more rows with weather than the smallest tables have.
NEED_ROWS = {"result_document", "ols_categorical", "ols_numeric", "ols_summary", "breusch_pagan", "vif", "residuals"}


def views(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def ducks(sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    return {False: (sf_dir, views(sf_dir)), True: (larger, views(larger))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, ducks, name):
    sf_dir, duck = ducks[name in NEED_ROWS]
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        result = compare(df, duck.execute(ORACLE[name]))
        assert result.startswith("ok"), result
    else:
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in IN_PYTHON:
        assert not any(node in plan for node in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"))


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"results_json"}


def test_entry(spark, sf_dir):
    assert entry(spark).columns == ["bpuic", "designationofficial", "cantonabbreviation", "n_halte", "mean_delay", "pct_late"]


def executed(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prepared", "weather_join", "station_lookup", "filter_region"])
def test_events_stay_in_place(spark, sf_dir, name):
    """Both look-up tables are small: no shuffle at all in the plan of the events."""
    plan = executed(spark, sf_dir, name)
    assert "BroadcastHashJoin" in plan
    assert "events.parquet" in plan.split("BroadcastExchange")[0] and "ShuffleQueryStage" not in plan.split("BroadcastExchange")[0]


@pytest.mark.parametrize("name, scans", [("describe", 1), ("mann_whitney", 0), ("median_per_station", 0)])
def test_values_are_counted_once(spark, sf_dir, name, scans):
    """The counts by value are stored and read again; beside the moments of one nothing reads the table again."""
    plan = executed(spark, sf_dir, name)
    # Each scan is shown in the final and in the initial plan.
    assert plan.count("FileScan parquet") == 2 * scans and "percentile_approx" not in plan
    assert "Scan ExistingRDD" in plan


def test_filter_reaches_the_file(spark, sf_dir):
    from taktspur.operators.filters import plausible
    df = plausible(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 100.0).select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,100.0)" in plan and "ReadSchema: struct<value:double>" in plan
