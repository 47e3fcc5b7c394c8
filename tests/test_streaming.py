import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kerbwise.operators import quality, spatial
from kerbwise.session import new_path
from kerbwise.sources import warehouse as wh
from kerbwise.streaming import jobs
from kerbwise.streaming import sources as streams


@pytest.fixture(scope="module")
def parts(spark, small):
    """The events as five files that arrive in the order of their times."""
    path = new_path(spark, "events")
    events = wh.table(spark, small, "events")
    days = [0, 6, 12, 18, 24, 400]
    for low, high in zip(days, days[1:]):
        age = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        events.where((age >= low) & (age < high)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(start, label, spark, again=None):
    folder = again or new_path(spark, label)
    start(f"{folder}/out", f"{folder}/check").awaitTermination()
    return folder


def batches(spark, small, parts, files=1):
    return streams.event_stream(spark, small, parts, files_per_batch=files)


def test_ingest_equals_batch_and_keeps_every_row_once(spark, small, parts):
    rows = batches(spark, small, parts, 2)
    folder = run(lambda o, c: jobs.ingest(rows, o, c), "ingest", spark)
    run(lambda o, c: jobs.ingest(rows, o, c), "ingest", spark, again=folder)  # nothing new
    got = jobs.read_ingested(spark, f"{folder}/out").select("accident_id", "cell", "is_valid")
    want = quality.with_reasons(wh.incidents(spark, small)).select(
        "accident_id", "cell", (F.size("reasons") == 0).alias("is_valid")
    )
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def hotspot_rows(df):
    cols = ["cell", "city", "accident_count", "avg_severity", "total_injured", "centroid", "latest_year"]
    return sorted(map(tuple, df.select(cols).collect()))


def test_hotspots_equal_batch_for_any_split_replay_and_compaction(spark, small, parts):
    rows = batches(spark, small, parts)
    folder = run(lambda o, c: jobs.refresh_hotspots(rows, o, c), "hot", spark)
    store = f"{folder}/out"
    want = hotspot_rows(spatial.hotspot_view(wh.incidents(spark, small)))
    assert want and hotspot_rows(jobs.current_hotspots(spark, store)) == want
    assert len([d for d in os.listdir(f"{store}/delta") if d.startswith("batch=")]) == 5
    # a replayed batch overwrites its own folder
    kept = new_path(spark, "kept")
    spark.read.parquet(f"{store}/delta/batch=0").write.parquet(kept)
    spark.read.parquet(kept).write.mode("overwrite").parquet(f"{store}/delta/batch=0")
    assert hotspot_rows(jobs.current_hotspots(spark, store)) == want
    # a base that was never finished is not used
    spark.read.parquet(f"{store}/delta/batch=0").write.parquet(f"{store}/base/upto=9")
    assert hotspot_rows(jobs.current_hotspots(spark, store)) == want
    last = jobs.compact_hotspots(spark, store)
    assert last == 4 == jobs.compact_hotspots(spark, store) and hotspot_rows(jobs.current_hotspots(spark, store)) == want
    # batches after the base count, batches before it do not count twice
    copy = new_path(spark, "copy")
    spark.read.parquet(f"{store}/delta/batch=4").write.parquet(copy)
    spark.read.parquet(copy).write.parquet(f"{store}/delta/batch=5")
    more = jobs.current_hotspots(spark, store, 1).agg(F.sum("accident_count")).first()[0]
    n4 = spark.read.parquet(copy).agg(F.sum("n")).first()[0]
    assert more == wh.incidents(spark, small).count() + n4
    assert jobs.compact_hotspots(spark, store) == 5
    assert jobs.current_hotspots(spark, store, 1).agg(F.sum("accident_count")).first()[0] == more


def test_folded_batches_leave_after_the_grace_period(spark, small, parts):
    store = new_path(spark, "hot")
    assert jobs.retire_hotspots(spark, store, dt.timedelta(0)) == (0, 0)
    rows = batches(spark, small, parts)
    jobs.refresh_hotspots(rows, store, new_path(spark, "check")).awaitTermination()
    assert jobs.retire_hotspots(spark, store, dt.timedelta(0)) == (0, 0)  # nothing is folded yet
    want = hotspot_rows(jobs.current_hotspots(spark, store))
    spare = new_path(spark, "spare")
    spark.read.parquet(f"{store}/delta/batch=4").write.parquet(spare)
    jobs.compact_hotspots(spark, store)
    before = jobs.current_hotspots(spark, store)
    assert jobs.retire_hotspots(spark, store, dt.timedelta(hours=1)) == (0, 0)
    assert jobs.retire_hotspots(spark, store, dt.timedelta(0)) == (5, 0)
    assert hotspot_rows(before) == want == hotspot_rows(jobs.current_hotspots(spark, store))  # the base alone
    assert jobs.compact_hotspots(spark, store) == 4
    # a batch run again after it was folded counts for nothing; a later one counts, and replaces the base when folded
    spark.read.parquet(spare).write.parquet(f"{store}/delta/batch=4")
    assert hotspot_rows(jobs.current_hotspots(spark, store)) == want
    spark.read.parquet(spare).write.parquet(f"{store}/delta/batch=5")
    more = hotspot_rows(jobs.current_hotspots(spark, store))
    assert more != want and jobs.compact_hotspots(spark, store) == 5
    assert jobs.retire_hotspots(spark, store, dt.timedelta(0)) == (2, 1)
    assert hotspot_rows(jobs.current_hotspots(spark, store)) == more


@pytest.mark.parametrize("salts", [1, 8])
def test_dedupe(spark, small, salts):
    path = new_path(spark, "lines")
    wh.table(spark, small, "lineitem").repartition(4).write.parquet(path)
    rows = streams.report_stream(spark, small, path, files_per_batch=1)
    folder = run(
        lambda o, c: jobs.write_deduplicated(rows, o, c, "3650 days", salts=salts), "dedupe", spark
    )
    got = spark.read.parquet(f"{folder}/out")
    want = wh.incident_reports(spark, small).select("accident_id").distinct()
    assert got.count() == want.count() == got.select("accident_id").distinct().count()


def test_late_copies_are_new_again_after_the_bound(spark, tmp_path):
    schema = "accident_id string, reported_at timestamp, n int"
    folder = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, "accident_id string, t string, n int").select(
            "accident_id", F.col("t").cast("timestamp").alias("reported_at"), "n"
        ).coalesce(1).write.mode("append").parquet(folder)

    arrive([("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 01:00:00", 2), ("B", "2024-01-01 02:00:00", 1)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.write_deduplicated(stream, out, check, "1 day").awaitTermination()
        return {r.accident_id: r["count"] for r in spark.read.parquet(out).groupBy("accident_id").count().collect()}

    assert drain() == {"A": 1, "B": 1}
    arrive([("A", "2024-01-01 12:00:00", 3), ("C", "2024-01-20 00:00:00", 1)])
    assert drain() == {"A": 1, "B": 1, "C": 1}  # still within the bound
    arrive([("A", "2024-01-20 12:00:00", 4)])
    assert drain() == {"A": 2, "B": 1, "C": 1}  # long after


def test_timely_first_copies_late_rows_and_state(spark, tmp_path):
    folder, store, check = (str(tmp_path / p) for p in ("in", "store", "check"))
    schema = "accident_id string, reported_at timestamp, n int"
    numbers = iter(range(100))

    def arrive(*rows):
        spark.createDataFrame([(i, t and f"2024-01-{t}", next(numbers)) for i, t in rows], "accident_id string, t string, n int").select(
            "accident_id", F.col("t").cast("timestamp").alias("reported_at"), "n"
        ).coalesce(1).write.mode("append").parquet(folder)
        jobs.deduplicate_timely(spark.readStream.schema(schema).parquet(folder), store, check, dt.timedelta(days=3)).awaitTermination()

    def out(target):
        return sorted((r.accident_id or "", r.n) for r in spark.read.parquet(f"{store}/{target}").collect())

    arrive(("A", "05"), ("A", "04"), ("B", "02"), (None, "05"), ("N", None))  # no mark yet: the earliest copy of each id
    assert out("first") == [("A", 1), ("B", 2)] and out("late") == [("", 3), ("N", 4)]
    arrive(("B", "01"), ("B", "03"), ("A", "09"), ("C", "10"))  # mark 02: B of day 01 is late, B of day 02 is remembered
    assert out("first") == [("A", 1), ("B", 2), ("C", 8)] and ("B", 5) in out("late")
    arrive(("A", "08"), ("B", "07"), ("C", "12"))  # mark 07: A of day 04 and B are forgotten, C is remembered
    assert out("first") == [("A", 1), ("A", 9), ("B", 2), ("B", 10), ("C", 8)] and len(out("late")) == 3
    # folders that ended before the mark are no longer read
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/first/number=0")
    arrive(("B", "20"), ("C", "11"))
    assert [x for x in out("first") if x[0] == "B"] == [("B", 10), ("B", 12)] and len(out("late")) == 3


def test_daily_cells(spark, small, parts):
    rows = batches(spark, small, parts)
    folder = run(lambda o, c: jobs.write_daily_cells(rows, o, c, "1 day"), "daily", spark)
    got = spark.read.parquet(f"{folder}/out")
    events = wh.table(spark, small, "events")
    last = events.agg(F.max("ts")).first()[0]
    facts = wh.with_cell(wh.incidents_from_events(events, spark, small).select("*"))
    want = (
        facts.groupBy(F.to_date("ts").alias("day"), "cell").agg(F.count("*").alias("accident_count"))
        .where(F.date_add("day", 1) <= F.lit(last) - F.expr("INTERVAL 1 DAY"))
    )
    assert got.select("day", "cell", "accident_count").exceptAll(want).count() == 0
    assert got.count() == want.count() > 0


def test_csv_stream(spark, incidents, tmp_path):
    from kerbwise.sources.files import write_incident_csv

    folder = str(tmp_path / "csv")
    write_incident_csv(incidents.repartition(3), folder)
    rows = streams.csv_stream(spark, folder, files_per_batch=1)
    done = run(lambda o, c: jobs.ingest(rows, o, c), "csv", spark)
    got = jobs.read_ingested(spark, f"{done}/out")
    assert got.count() == incidents.count()
    assert got.select("accident_id", "cell").exceptAll(incidents.select("accident_id", "cell")).count() == 0


def test_csv_stream_keeps_lines_that_do_not_parse_in_quarantine(spark, incidents, tmp_path):
    from kerbwise.sources.files import write_incident_csv

    folder = str(tmp_path / "csv")
    severity = F.when(F.col("severity") == 3, "high").otherwise(F.col("severity").cast("string"))
    write_incident_csv(incidents.withColumn("severity", severity).coalesce(1), folder)
    bad, n = incidents.where("severity = 3").count(), incidents.count()
    rows = streams.csv_stream(spark, folder)
    done = run(lambda o, c: jobs.ingest(rows, o, c), "csv", spark)
    got = jobs.read_ingested(spark, f"{done}/out")
    unparsed = got.where("reasons = array('unparsable') AND NOT is_valid")
    assert bad > 0 and got.count() == n and unparsed.count() == bad == unparsed.where("unparsed LIKE 'ACC%,high,%'").count()
    hot = run(lambda o, c: jobs.refresh_hotspots(rows, o, c), "hot", spark)
    total = jobs.current_hotspots(spark, f"{hot}/out", 1).agg(F.sum("accident_count")).first()[0]
    assert total == incidents.where("severity <> 3").count()


def test_a_store_belongs_to_one_checkpoint(spark, small, parts):
    rows = batches(spark, small, parts, 3)
    folder = run(lambda o, c: jobs.refresh_hotspots(rows, o, c), "hot", spark)
    store, want = f"{folder}/out", hotspot_rows(spatial.hotspot_view(wh.incidents(spark, small)))
    jobs.compact_hotspots(spark, store)
    with pytest.raises(Exception, match="another checkpoint"):
        jobs.refresh_hotspots(rows, store, new_path(spark, "check")).awaitTermination()
    assert hotspot_rows(jobs.current_hotspots(spark, store)) == want
    run(lambda o, c: jobs.refresh_hotspots(rows, o, c), "hot", spark, again=folder)  # its own checkpoint may go on
    other = run(lambda o, c: jobs.refresh_hotspots(rows, o, c), "hot", spark)
    both = jobs.current_hotspots(spark, [store, f"{other}/out"], 1).agg(F.sum("accident_count")).first()[0]
    assert both == 2 * wh.incidents(spark, small).count()


def test_no_hotspots_before_the_first_batch(spark):
    store = new_path(spark, "empty")
    assert jobs.current_hotspots(spark, store).count() == 0 and jobs.compact_hotspots(spark, store) == -1


def test_identical_copies_of_a_hot_id(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("accident_id"),
        F.lit("2024-01-01").cast("timestamp").alias("reported_at"),
    ).write.parquet(folder)
    stream = spark.readStream.schema("accident_id string, reported_at timestamp").parquet(folder)
    out = str(tmp_path / "out")
    jobs.write_deduplicated(stream, out, str(tmp_path / "check"), "1 day").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2001 and got.where("accident_id = 'HOT'").count() == 1
