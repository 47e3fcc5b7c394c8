"""The fact store: ids unique over all batches, commits, and result tables replaced under a reader's eyes."""

import datetime as dt
import re
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kerbwise.session import new_path, written
from kerbwise.sources import facts
from kerbwise.sources.results import ResultStore
from tests.rows import make


def ids(store):
    return sorted((r.accident_id, r.batch) for r in store.facts().collect())


def rejected(store):
    return sorted((r.accident_id, r.batch, ",".join(r.reasons), r.copies) for r in store.quarantine().collect())


@pytest.fixture()
def store(spark):
    return facts.FactStore(spark, new_path(spark, "facts"), buckets=8)


def rows(spark, *items):
    return make(spark, *[{"accident_id": i, **dict(more)} for i, *more in items], cell=False)


def test_an_id_enters_once(spark, store):
    assert store.facts().count() == 0 and store.quarantine().count() == 0
    newer = ("accident_datetime", dt.datetime(2021, 5, 5))
    assert store.append(rows(spark, ("a",), ("b",), ("b",), ("b", newer), ("x", ("severity", 9)))) == 1
    assert ids(store) == [("a", 1), ("b", 1)]
    assert rejected(store) == [("b", 1, facts.DUPLICATE, 2), ("x", 1, "severity_value", 1)]
    assert store.append(rows(spark, ("b",), ("b",), ("b", newer), ("c",), ("c",), ("a", ("severity", 8)))) == 2
    assert ids(store) == [("a", 1), ("b", 1), ("c", 2)]
    assert rejected(store)[0] == ("a", 2, "severity_value", 1)
    assert sum(n for i, b, why, n in rejected(store) if (i, b, why) == ("b", 2, facts.KNOWN)) == 3
    assert ("c", 2, facts.DUPLICATE, 1) in rejected(store)
    # a batch of known ids only, an empty batch
    assert store.append(rows(spark, ("a",), ("c",))) == 3 and store.append(rows(spark, ("a",)).where("false")) == 4
    assert ids(store) == [("a", 1), ("b", 1), ("c", 2)] and store.facts().where("cell IS NULL OR created_at IS NULL").count() == 0


def test_only_touched_buckets_are_read(spark, store):
    store.append(rows(spark, *((f"id{i}",) for i in range(200))))
    one = spark.createDataFrame([("id7",)], "accident_id string").withColumn("bucket", store._bucket(F.col("accident_id")))
    known = store._known(one)
    assert [r.accident_id for r in known.collect()] == ["id7"]
    bucket = one.first()["bucket"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*bucket#\d+ = {bucket}\)", plan) and "ReadSchema: struct<accident_id:string>" in plan


def test_what_was_not_committed_is_not_read(spark, store):
    store.append(rows(spark, ("a",)))
    run = store.commits()[0][1]
    for part in ("fact", "ids"):  # another run broke off before its commit
        spark.read.parquet(f"{store.folder}/{part}/run={run}").write.parquet(f"{store.folder}/{part}/run=rbroken")
    assert ids(store) == [("a", 1)]
    with pytest.raises(AnalysisException):  # a second run that took the same number
        store._commit(1, "rbroken")
    assert store.append(rows(spark, ("a",), ("b",))) == 2 and ids(store) == [("a", 1), ("b", 2)]


def test_many_batches_equal_one_pass_over_all(spark, store, incidents):
    part = F.pmod(F.xxhash64("accident_id", "n"), F.lit(4))
    copies = written(incidents.drop("cell").limit(400).withColumn("year", F.lit(2020)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("part", part), "copies")
    first = {r.accident_id: r["first"] + 1 for r in copies.groupBy("accident_id").agg(F.min("part").alias("first")).collect()}
    for i in range(4):
        store.append(copies.where(f"part = {i}").drop("n", "part"))
    assert dict(ids(store)) == first and len(ids(store)) == 400
    assert sum(n for *_, n in rejected(store)) == 800


def test_readers_see_a_whole_table_while_it_is_replaced(spark):
    store = ResultStore(spark, new_path(spark, "results"))
    version = lambda k: spark.range(100 + k).select(F.lit(k).alias("version"), "id")
    store.save(version(0), "numbers")
    held, seen, wrong, done = store.load("numbers"), set(), [], threading.Event()

    def read():
        while not done.is_set():
            found = store.load("numbers").groupBy("version").count().collect()
            if len(found) != 1 or found[0]["count"] != 100 + found[0]["version"]:
                wrong.append(found)
            else:
                seen.add(found[0]["version"])

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        store.save(version(k), "numbers")
    done.set()
    reader.join()
    assert not wrong and seen and store.load("numbers").count() == 105 and held.count() == 100
    assert store.retire("numbers", dt.timedelta(hours=1)) == 0 and store.retire("numbers", dt.timedelta(0)) == 5
    assert store.load("numbers").count() == 105 and store.retire("numbers", dt.timedelta(0)) == 0
    with pytest.raises(ValueError):
        store.load("nothing")
