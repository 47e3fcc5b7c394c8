"""Every registered query against its SQL on the smallest warehouse, and plan properties."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from kerbwise.operators import radius, spatial, summary
from kerbwise.plans import registry
from oracle.compare import difference, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TRAINING = {
    "severity_predictions", "severity_boosted", "severity_report", "cv_results", "hotspot_predictions",
    "casualty_predictions", "feature_importance", "score_batch",
}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_each_query_has_sql_unless_it_trains():
    assert set(registry.queries()) - set(SQL) == TRAINING and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, small, con):
    got = QUERIES[name](spark, small).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ["score_batch", "hotspot_predictions", "casualty_predictions"])
def test_training_query(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "cell" and df.count() >= 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_operators_stay_in_the_jvm(spark, small):
    for name in ("spatial_clusters", "features", "radius_join", "neighbor_density", "city_report", "road_match"):
        text = plan(QUERIES[name](spark, small))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_they_need(spark, incidents):
    text = plan(summary.overview_kpis(incidents, dt.datetime(2001, 8, 1)))
    assert "vehicle_type" not in text.split("ReadSchema")[1]
    box = plan(radius.within_radius(incidents, 15.0, 75.5, 5000))
    assert "GreaterThanOrEqual(latitude" in box and "LessThanOrEqual(longitude" in box


def test_top_cells_are_pruned_before_the_shuffle(incidents):
    text = plan(spatial.city_top_cells(incidents))
    assert text.index("WindowGroupLimit", text.index("Exchange")) > 0


def test_small_sides_are_not_forced_when_broadcast_is_off(spark, incidents, small):
    from kerbwise.learning.features import feature_table

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = feature_table(incidents)
        assert "BroadcastHashJoin" not in plan(shuffled)
        rows = shuffled.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == incidents.count()


def test_rows_around_requests_are_found_by_a_shuffled_join_and_not_shuffled_themselves(spark, small):
    text = plan(QUERIES["sql_radius_requests"](spark, small))
    joins = [line for line in text.splitlines() if "Join [" in line]
    assert "BroadcastHashJoin [knownfloatingpointnormalized" in joins[0] and "latitude" in joins[0]
    assert any("SortMergeJoin [bucket" in line for line in joins)
