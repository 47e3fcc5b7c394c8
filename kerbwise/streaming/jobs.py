"""Streaming jobs: ingest, deduplication, hotspot refresh and daily cell counts.

Only :func:`ingest` keeps lines that did not parse, in its quarantine; the other jobs leave them out.
Every job takes an output folder and a checkpoint folder, both shared by all
executors. With ``once`` it drains what is there and stops; otherwise it keeps
running on the given interval.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from kerbwise import fixed
from kerbwise.functions.geo import MICRO, micro_degrees, point
from kerbwise.operators.filters import located
from kerbwise.operators.quality import incident_defaults, parsed, with_reasons
from kerbwise.session import written
from kerbwise.sources.results import folders, removed, stored
from kerbwise.streaming.sources import EVENT_TIME

PARTIAL_KEYS = ["cell", "city", "state"]
PARTIAL_SUMS = [
    "n", "n_severity", "severity_sum", "casualties_sum", "fatalities_sum", "injured_sum",
    "n_located", "lat_sum", "lon_sum",
]
PARTIAL_SCHEMA = (
    "cell long, city string, state string, n long, n_severity long, severity_sum long, "
    "casualties_sum long, fatalities_sum long, injured_sum long, n_located long, lat_sum double, "
    "lon_sum double, first_datetime timestamp_ntz, last_datetime timestamp_ntz"
)


def _start(writer: DataStreamWriter, checkpoint: str, once: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return timed.start()


def ingest(
    rows: DataFrame, out: str, checkpoint: str, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Validate incidents into ``out``: valid rows and quarantine side by side, each row once."""
    checked = with_reasons(incident_defaults(rows)).withColumn(
        "is_valid", F.size("reasons") == 0
    )
    writer = (
        checked.writeStream.format("parquet")
        .option("path", out)
        .partitionBy("is_valid")
        .outputMode("append")
    )
    return _start(writer, checkpoint, once, every)


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """What ``ingest`` has written, with ``is_valid`` as a boolean."""
    return spark.read.parquet(out).withColumn("is_valid", F.col("is_valid").cast("boolean"))


def deduplicated(
    rows: DataFrame, lateness: str, key: str = "accident_id", salts: int = 8
) -> DataFrame:
    """First copy of each id within the lateness bound.

    Copies are first reduced per (id, salt) and then per id. An id that makes up
    a large share of the stream is spread over ``salts`` tasks, and at most that
    many copies of it per lateness interval reach the second step. The salt is the
    input partition, so even identical copies are spread; whatever the salts, the
    second step decides. Copies further apart than the bound may or may not be
    dropped, as with any deduplication by watermark.
    """
    marked = parsed(rows).withWatermark(EVENT_TIME, lateness)
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        marked = (
            marked.withColumn("_salt", salt)
            .dropDuplicatesWithinWatermark([key, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark([key])


def write_deduplicated(
    rows: DataFrame, out: str, checkpoint: str, lateness: str, salts: int = 8,
    once: bool = True, every: str = "1 minute",
) -> StreamingQuery:
    writer = (
        deduplicated(rows, lateness, salts=salts)
        .writeStream.format("parquet").option("path", out).outputMode("append")
    )
    return _start(writer, checkpoint, once, every)


FINISHED = "number long, newest long"
FOLDED = "upto long, at timestamp"


def deduplicate_timely(
    rows: DataFrame, store: str, checkpoint: str, bound: dt.timedelta, key: str = "accident_id",
    once: bool = True, every: str = "1 minute",
) -> StreamingQuery:
    """First copy of each id into ``store/first``, rows that come too late into ``store/late``.

    The mark of a batch is the newest event time of the batches before it, less ``bound``. A row before the
    mark is late, and so is one without id or event time. Of the other rows of an id the earliest is the first copy, unless
    the id left an earlier batch with an event time at or after the mark. What has left before the mark is no longer state: neither its
    rows nor the folders of batches that end before it are read, so the state is that of one bound, however long
    the stream runs. Each batch writes folders of its own, so a batch that is run again changes nothing.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        finished = [r for r in stored(spark, f"{store}/finished", FINISHED).collect() if r["number"] < number]  # one row a batch
        newest = max((r["newest"] for r in finished if r["newest"] is not None), default=None)
        timely = F.col(key).isNotNull() & F.col(EVENT_TIME).isNotNull()
        if newest is not None:
            mark = newest - bound // dt.timedelta(microseconds=1)
            timely &= F.col(EVENT_TIME) >= F.timestamp_micros(F.lit(mark))
        held = written(batch.withColumn("_timely", F.coalesce(timely, F.lit(False))), "timely")
        columns = batch.columns
        row = F.struct(F.col(EVENT_TIME).alias("_at"), *[F.col(c) for c in columns])
        first = held.where("_timely").groupBy(key).agg(F.min(row).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])
        if newest is not None:
            open_ = [r["number"] for r in finished if r["newest"] is not None and r["newest"] >= mark]
            state = spark.read.schema(first.schema).parquet(*[f"{store}/first/number={i}" for i in open_])
            state = state.where(F.col(EVENT_TIME) >= F.timestamp_micros(F.lit(mark))).select(key)
            first = first.join(state, key, "left_anti")
        first.select(*columns).write.mode("overwrite").parquet(f"{store}/first/number={number}")
        held.where(~F.col("_timely")).drop("_timely").write.mode("overwrite").parquet(f"{store}/late/number={number}")
        seen = held.agg(F.unix_micros(F.max(EVENT_TIME)).alias("newest")).coalesce(1)
        seen.write.mode("overwrite").parquet(f"{store}/finished/number={number}")

    return _start(parsed(rows).writeStream.foreachBatch(write_batch), checkpoint, once, every)


def hotspot_partials(rows: DataFrame) -> DataFrame:
    """Mergeable sums of each (cell, city, state)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return (
        rows.groupBy(*PARTIAL_KEYS)
        .agg(
            F.count("cell").alias("n"),
            F.count("severity").alias("n_severity"),
            F.sum("severity").alias("severity_sum"),
            F.sum("casualties").alias("casualties_sum"),
            F.sum("fatalities").alias("fatalities_sum"),
            F.sum("injured").alias("injured_sum"),
            F.count(lat).alias("n_located"),
            F.sum(micro_degrees(lat).cast("double")).alias("lat_sum"),
            F.sum(micro_degrees(lon).cast("double")).alias("lon_sum"),
            F.min("accident_datetime").alias("first_datetime"),
            F.max("accident_datetime").alias("last_datetime"),
        )
        .where(F.col("n") > 0)
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*PARTIAL_KEYS).agg(
        *[F.sum(name).alias(name) for name in PARTIAL_SUMS],
        F.min("first_datetime").alias("first_datetime"),
        F.max("last_datetime").alias("last_datetime"),
    )


def refresh_hotspots(
    rows: DataFrame, store: str, checkpoint: str, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Keep hotspot sums current: each micro-batch writes its own partial sums.

    A batch overwrites only its own folder, so a replayed batch changes nothing. Batches are numbered by
    the checkpoint, so a store belongs to one checkpoint and any other is refused: it takes a store of its
    own, and :func:`current_hotspots` merges stores.
    """
    claimed = False

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        nonlocal claimed
        if not claimed:
            _claim(batch.sparkSession, store, checkpoint)
            claimed = True
        hotspot_partials(batch).write.mode("overwrite").parquet(f"{store}/delta/batch={batch_id}")

    return _start(parsed(rows).writeStream.foreachBatch(write_batch), checkpoint, once, every)


def _claim(spark: SparkSession, store: str, checkpoint: str) -> None:
    """Note the id of the checkpoint's query as the owner of the store; another owner is an error."""
    query = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
    owners = [row["id"] for row in stored(spark, f"{store}/owner", "id string").collect()]
    if not owners:
        spark.range(1).select(F.lit(query).alias("id")).write.parquet(f"{store}/owner")
    elif owners != [query]:
        raise ValueError(f"{store} belongs to another checkpoint; use a new store and read both")


def _deltas(spark: SparkSession, store: str) -> DataFrame:
    return stored(spark, f"{store}/delta", f"{PARTIAL_SCHEMA}, batch long")


def _merged_up_to(spark: SparkSession, store: str) -> int:
    """Last batch of the newest finished base, -1 without one."""
    newest = stored(spark, f"{store}/finished", FOLDED).agg(F.max("upto")).first()[0]
    return -1 if newest is None else newest


def _current_partials(spark: SparkSession, store: str, last: int | None = None) -> DataFrame:
    """The newest finished base and the batches after it, up to ``last``."""
    upto = _merged_up_to(spark, store)
    later = _deltas(spark, store).where(F.col("batch") > upto)
    if last is not None:
        later = later.where(F.col("batch") <= last)
    later = later.drop("batch")
    if upto < 0:
        return later
    base = spark.read.schema(PARTIAL_SCHEMA).parquet(f"{store}/base/upto={upto}")
    return base.unionByName(later)


def compact_hotspots(spark: SparkSession, store: str) -> int:
    """Fold all batches so far into one base table; returns the last batch it covers.

    Readers use a base only once it is listed as finished, which is the last step,
    so an interrupted run leaves the table as it was and can be repeated. Batches that
    arrive meanwhile are not part of the base.
    """
    last = _deltas(spark, store).agg(F.max("batch")).first()[0]
    done = _merged_up_to(spark, store)
    if last is None or last <= done:
        return done
    merge_partials(_current_partials(spark, store, last)).write.mode("overwrite").parquet(
        f"{store}/base/upto={last}"
    )
    row = spark.range(last, last + 1, 1, 1).select(F.col("id").alias("upto"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{store}/finished")
    return last


def retire_hotspots(spark: SparkSession, store: str, grace: dt.timedelta) -> tuple[int, int]:
    """Remove the batches and bases that a base finished more than ``grace`` ago replaces; returns how many of each.

    Readers that chose their base before then must have ended. A batch that its checkpoint runs again writes a
    folder that the base covers, so it counts for nothing and leaves with the next call.
    """
    finished = stored(spark, f"{store}/finished", FOLDED)
    settled = F.max(F.when(F.col("at") < F.current_timestamp() - F.lit(grace), F.col("upto")))
    upto = finished.agg(settled).first()[0]
    if upto is None:
        return 0, 0
    # Numbers of folders, of which each call leaves only those after the base.
    batches = [n for n in folders(spark, f"{store}/delta", "batch") if n <= upto]
    bases = [n for n in folders(spark, f"{store}/base", "upto") if n < upto]
    removed(spark, [f"{store}/delta/batch={n}" for n in batches] + [f"{store}/base/upto={n}" for n in bases])
    return len(batches), len(bases)


def current_hotspots(
    spark: SparkSession, store: str | list[str], min_incidents: int = fixed.CLUSTER_MIN_INCIDENTS
) -> DataFrame:
    """The hotspot table of one or several stores as of their last batches; the threshold applies to merged counts."""
    stores = [store] if isinstance(store, str) else store
    partials = reduce(DataFrame.unionByName, [_current_partials(spark, s) for s in stores])
    lat = F.try_divide("lat_sum", "n_located") / MICRO
    lon = F.try_divide("lon_sum", "n_located") / MICRO
    return (
        merge_partials(partials)
        .where(F.col("n") >= min_incidents)
        .select(
            *PARTIAL_KEYS,
            F.col("n").alias("accident_count"),
            F.try_divide("severity_sum", "n_severity").alias("avg_severity"),
            F.col("casualties_sum").alias("total_casualties"),
            F.col("fatalities_sum").alias("total_fatalities"),
            F.col("injured_sum").alias("total_injured"),
            point(lon, lat).alias("centroid"),
            F.year("first_datetime").alias("earliest_year"),
            F.year("last_datetime").alias("latest_year"),
        )
    )


def daily_cells(rows: DataFrame, lateness: str) -> DataFrame:
    """Incidents of each cell and day of report; a day appears once it is closed."""
    return (
        located(parsed(rows))
        .withWatermark(EVENT_TIME, lateness)
        .groupBy(F.window(EVENT_TIME, "1 day"), "cell")
        .agg(F.count("*").alias("accident_count"), F.avg("severity").alias("avg_severity"))
        .select(
            F.col("window.start").cast("date").alias("day"), "cell", "accident_count", "avg_severity"
        )
    )


def write_daily_cells(
    rows: DataFrame, out: str, checkpoint: str, lateness: str = "1 day",
    once: bool = True, every: str = "1 minute",
) -> StreamingQuery:
    writer = (
        daily_cells(rows, lateness)
        .writeStream.format("parquet").option("path", out).outputMode("append")
    )
    return _start(writer, checkpoint, once, every)
