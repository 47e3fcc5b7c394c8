"""Hot keys: plans that split them, and results that stay whole."""

import contextlib

from pyspark.sql import functions as F

from kerbwise.learning import encoding
from kerbwise.learning.features import feature_table
from kerbwise.operators import radius, spatial, summary
from kerbwise.session import written
from kerbwise.sources import synthetic

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def settings(spark, values):
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in values:
            spark.conf.unset(key)


def crowded(spark, rows=24000):
    """A third of all incidents lie in one cell of one city."""
    ids = spark.range(0, rows, 1, 16)
    base = synthetic.synthesize(ids, "id")
    number = F.substring("accident_id", 5, 9).cast("long") - 1
    hot = number % 3 == 0
    jitter = F.pmod(F.xxhash64("accident_id"), F.lit(1000)) / 1e6
    df = base.withColumns(
        {
            "city": F.when(hot, "Pune").otherwise(F.col("city")),
            "state": F.when(hot, "Maharashtra").otherwise(F.col("state")),
            "latitude": F.when(hot, 18.5 + jitter).otherwise(F.col("latitude")),
            "longitude": F.when(hot, 73.8 + jitter).otherwise(F.col("longitude")),
        }
    )
    from kerbwise.functions.geo import with_cell

    return written(with_cell(df).repartition(16), "crowded")


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_on_a_hot_cell_is_split(spark):
    df = crowded(spark)
    with settings(spark, SHUFFLED):
        rows = feature_table(df).select("accident_id", "cell", "cell_density")
        plan = final_plan(rows)
        assert "skew=true" in plan
        assert rows.count() == df.count()
        busiest = rows.agg(F.max("cell_density")).first()[0]
    assert busiest >= df.count() / 3


def test_join_on_a_hot_bucket_is_split(spark):
    df = crowded(spark)
    centers = spark.createDataFrame(
        [(1, 18.5, 73.8), (2, 19.07, 72.87), (3, 28.7, 77.1)], "road_id int, center_lat double, center_lon double"
    )
    direct = {r.road_id: r.accident_count for r in radius.incidents_around(df, centers, "road_id", 4000.0).collect()}
    with settings(spark, SHUFFLED):
        pairs = radius.radius_join(df.select("accident_id", "latitude", "longitude"), centers, 4000.0)
        assert "skew=true" in final_plan(pairs)
        assert {r.road_id: r["count"] for r in pairs.groupBy("road_id").count().collect()} == direct
    assert direct[1] >= df.count() / 3


def test_a_hot_cell_reaches_the_shuffle_as_one_row_per_task(spark):
    df = crowded(spark)
    clusters = spatial.spatial_clusters(df)
    clusters.write.format("noop").mode("overwrite").save()
    text = clusters._jdf.queryExecution().executedPlan().toString()
    first_exchange = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[first_exchange:]
    assert clusters.first().accident_count >= df.count() / 3


def test_a_hot_city_does_not_gather_its_rows(spark):
    df = crowded(spark)
    text = spatial.city_top_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    top = summary.insights(df).where("title = 'Peak Hour Alert'").count()
    assert top == 1


def test_hot_stratum_split_is_exact(spark):
    df = crowded(spark)
    rows = encoding.stratified_split(df.select("accident_id", "city"), "accident_id", "city")
    counts = rows.groupBy("city").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
    assert all(r.t == int(r.n * 0.8) for r in counts) and len(counts) == 10
