"""Constraints of the incident table as one validation pass, and key deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.schema import UNPARSED
from kerbwise.session import written


def _range_rules(ranges: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {
        f"{name}_range": ~F.col(name).between(low, high) for name, (low, high) in ranges.items()
    }


def _missing_rules(names: tuple[str, ...]) -> dict[str, Column]:
    return {f"{name}_missing": F.col(name).isNull() for name in names}


def incident_rules() -> dict[str, Column]:
    """Reason -> condition of each violation. As in SQL, a null passes a range check."""
    return {
        **_missing_rules(("accident_id", *fixed.REQUIRED)),
        **_range_rules(fixed.RANGES),
        "severity_value": ~F.col("severity").isin(1, 2, 3),
    }


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def _broken(rules: dict[str, Column]) -> Column:
    """Whether any rule is violated, as one plain predicate."""
    out = F.lit(False)
    for broken in rules.values():
        out = out | F.coalesce(broken, F.lit(False))
    return out


def with_reasons(df: DataFrame) -> DataFrame:
    """``reasons`` of each row; a line that does not parse has that one reason."""
    reasons = _reasons(incident_rules())
    if UNPARSED in df.columns:
        reasons = F.when(F.col(UNPARSED).isNotNull(), F.array(F.lit("unparsable"))).otherwise(reasons)
    return df.withColumn("reasons", reasons)


def _rejected(df: DataFrame) -> Column:
    broken = _broken(incident_rules())
    return broken | F.col(UNPARSED).isNotNull() if UNPARSED in df.columns else broken


def parsed(df: DataFrame) -> DataFrame:
    """Rows that parsed, without the column for those that did not."""
    return df.where(F.col(UNPARSED).isNull()).drop(UNPARSED) if UNPARSED in df.columns else df


def valid_rows(df: DataFrame) -> DataFrame:
    return parsed(df).where(~_broken(incident_rules()))


def quarantine(df: DataFrame) -> DataFrame:
    """Rejected rows with their reasons; reasons are only built for these."""
    return with_reasons(df.where(_rejected(df)))


def violation_counts(df: DataFrame) -> DataFrame:
    """Rows per violated rule."""
    return with_reasons(df).select(F.explode("reasons").alias("reason")).groupBy("reason").count()


def request_reasons(df: DataFrame) -> DataFrame:
    """Trip requests with the rules they break; a missing value is a violation here."""
    rules = {**_missing_rules(tuple(fixed.REQUEST_RANGES)), **_range_rules(fixed.REQUEST_RANGES)}
    return df.withColumn("reasons", _reasons(rules))


def incident_defaults(df: DataFrame) -> DataFrame:
    """Column defaults of the incident table."""
    return df.na.fill(0, ["casualties", "fatalities", "injured"])


def request_defaults(df: DataFrame) -> DataFrame:
    return df.na.fill("Clear", ["weather"])


def road_defaults(df: DataFrame) -> DataFrame:
    return df.na.fill(False, ["oneway"])


def stamped(df: DataFrame) -> DataFrame:
    """Creation time, set where it is missing."""
    now = F.current_timestamp()
    return df.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in df.columns else now)


def duplicate_keys(df: DataFrame, key: str = "accident_id", order_by: str = "accident_datetime") -> DataFrame:
    """Ids with more than one row: number of copies and time of the newest.

    A plain hash aggregate, so an id with very many copies is combined map-side.
    """
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("copies"), F.max(order_by).alias("kept_at"))
        .where(F.col("copies") > 1)
    )


def marked_contents(df: DataFrame, key: str = "accident_id", order_by: str = "accident_datetime") -> DataFrame:
    """Rows with a key, once per content: ``copies`` is the number of rows it stands for, ``is_kept`` marks one content of each key.

    That is the newest; of equally new ones the one with the largest hash, and a content without a time is the oldest.
    One aggregate, combined map-side, reduces the rows to their contents, which are written with a number each. Winners
    are chosen among (key, time, hash, number), and only keys with several contents are looked at further: the numbers
    that lost are written, so their real size decides how they are joined. No wide row is compared or sorted, and
    where contents of a key differ seldom none is shuffled again. A hot key is one row per map task and distinct
    content before the shuffle.
    """
    columns = df.columns
    contents = written(
        df.where(F.col(key).isNotNull())
        .groupBy(*columns)
        .agg(F.count("*").alias("copies"))
        .withColumn("_number", F.monotonically_increasing_id()),
        "contents",
    )
    at, number = F.col("_at"), F.col("_number")
    numbered = contents.select(F.col(key).alias("_key"), F.col(order_by).alias("_at"), F.xxhash64(*columns).alias("_hash"), number)
    winners = written(
        numbered.groupBy("_key", "_at")
        .agg(F.max_by(number, "_hash").alias("_number"), F.count("*").alias("_n"))
        .groupBy("_key")
        .agg(
            F.coalesce(F.max_by(number, at), F.max(F.when(at.isNull(), number))).alias("_winner"), F.sum("_n").alias("_n")
        )
        .where(F.col("_n") > 1)
        .select("_key", "_winner"),
        "winners",
    )
    lost = written(
        numbered.select("_key", "_number").join(winners, "_key").where(number != F.col("_winner")).select("_number", F.lit(False).alias("_kept")),
        "lost",
    )
    return contents.join(lost, "_number", "left").select(*columns, "copies", F.coalesce("_kept", F.lit(True)).alias("is_kept"))


def deduplicate(
    df: DataFrame, key: str = "accident_id", order_by: str = "accident_datetime"
) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus): the newest row of each key, and every other row once per content.

    ``surplus.copies`` is the number of rows it stands for. Which row is kept says :func:`marked_contents`.
    Rows without a key are kept.
    """
    contents = marked_contents(df, key, order_by)
    kept = contents.where("is_kept").select(df.columns).unionByName(df.where(F.col(key).isNull()))
    left = F.col("copies") - F.col("is_kept").cast("long")
    return kept, contents.withColumn("copies", left).where(F.col("copies") > 0).drop("is_kept")
