"""Label codes, standardisation and repeatable splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.session import written

MISSING_LABEL = "None"
DIGEST_LEVEL = 4  # signs of a digest that each narrowing adds: 65536 buckets
DIGEST_SIGNS = 32
RANKED_ROWS = 100_000  # of one stratum in the last step of a split


def _label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL))


def fit_encoders(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, code): the rank of each distinct value, from 0.

    Values are dealt by range, ranked inside their range, and offset by the number of values
    in the ranges before. So no task sorts all values of a feature, whatever they begin
    with; the running sum covers one row per range.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), _label(c).alias("value")) for c in columns]
    )
    values = written(
        df.select(*columns)
        .distinct()
        .select(F.explode(pairs).alias("p"))
        .select("p.feature", "p.value")
        .distinct()
        .repartitionByRange("feature", "value")
        .withColumn("range", F.spark_partition_id()),
        "labels",
    )
    before = (
        Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        values.groupBy("feature", "range")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("feature", "range").orderBy("value")
    return (
        values.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["feature", "range"])
        .select("feature", "value", (F.col("offset") + F.col("rank")).cast("int").alias("code"))
    )


def encode(df: DataFrame, encoders: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_encoded``; a value without a code gets 0."""
    out = df
    for column in columns:
        codes = encoders.where(F.col("feature") == column).select(
            F.col("value").alias("_value"), F.col("code").alias(f"{column}_encoded")
        )
        out = (
            out.join(codes, _label(column) == F.col("_value"), "left")
            .drop("_value")
            .na.fill(0, [f"{column}_encoded"])
        )
    return out


def unseen_values(df: DataFrame, encoders: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, rows): values that have no code."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), _label(c).alias("value")) for c in columns]
    )
    counted = (
        df.groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.feature", "p.value")
        .agg(F.sum("n").alias("rows"))
    )
    return counted.join(encoders, ["feature", "value"], "left_anti")


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; one row reaches the driver."""
    stats = []
    for column in columns:
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        stats += [F.avg(value).alias(f"m_{column}"), F.stddev_pop(value).alias(f"s_{column}")]
    row = df.agg(*stats).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``<column>_z``: nulls as 0, then mean 0 and deviation 1 (constant columns only centred)."""
    return df.withColumns(
        {
            f"{c}_z": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - mean) / deviation
            for c, (mean, deviation) in scaler.items()
        }
    )


def _digest(key: str) -> Column:
    return F.md5(F.col(key).cast("string").cast("binary"))


def _order_key(key: str) -> Column:
    return F.concat(_digest(key), F.col(key).cast("string"))


def split_points(
    df: DataFrame, key: str, stratum: str, fraction: float, most: int = RANKED_ROWS
) -> DataFrame:
    """(stratum, cut): rows whose digest is at most ``cut`` make up ``fraction`` of the stratum.

    The rows of each stratum are counted by the first signs of their digest, and only those of the bucket
    that holds the boundary are kept, until no stratum keeps more than ``most`` rows or the whole digest
    is used. What is left is counted by its full key, so rows that repeat one id are one row of the last
    step. No task orders more than 65536 buckets or ``most`` keys of a stratum.
    """
    rows = df.select(F.col(stratum).alias("stratum"), _order_key(key).alias("cut"))
    wanted = F.floor(F.sum("n").over(Window.partitionBy("stratum")) * F.lit(fraction))
    signs = DIGEST_LEVEL
    counts = rows.groupBy("stratum", F.substring("cut", 1, signs).alias("prefix")).agg(F.count("*").alias("n"))
    level = written(_holding(counts.withColumn("take", wanted), "prefix"), "boundary")
    rows = written(_inside(rows, level, signs), "boundary-rows")
    while signs < DIGEST_SIGNS and (level.agg(F.max("n")).first()[0] or 0) > most:
        signs += DIGEST_LEVEL
        counts = rows.groupBy("stratum", "take", F.substring("cut", 1, signs).alias("prefix")).agg(F.count("*").alias("n"))
        level = written(_holding(counts, "prefix"), "boundary")
        rows = written(_inside(rows.drop("take"), level, signs), "boundary-rows")
    counts = rows.groupBy("stratum", "take", "cut").agg(F.count("*").alias("n"))
    return _holding(counts, "cut").select("stratum", "cut")


def _holding(counts: DataFrame, order: str) -> DataFrame:
    """The group of each stratum that holds its ``take``-th row, and that row's number inside the group."""
    up_to = F.sum("n").over(Window.partitionBy("stratum").orderBy(order))
    return (
        counts.withColumn("before", up_to - F.col("n"))
        .where((F.col("take") > F.col("before")) & (F.col("take") <= F.col("before") + F.col("n")))
        .select("stratum", order, "n", (F.col("take") - F.col("before")).alias("take"))
    )


def _inside(rows: DataFrame, level: DataFrame, signs: int) -> DataFrame:
    chosen = level.select(F.col("stratum").alias("_stratum"), F.col("prefix").alias("_prefix"), "take")
    here = F.col("stratum").eqNullSafe(F.col("_stratum")) & (F.substring("cut", 1, signs) == F.col("_prefix"))
    return rows.join(chosen, here).drop("_stratum", "_prefix")


def stratified_split(
    df: DataFrame, key: str, stratum: str, fraction: float = 0.8, most: int = RANKED_ROWS
) -> DataFrame:
    """Add ``is_train``: exactly floor(fraction * n) rows of each stratum, chosen by id digest.

    Rows without a stratum are a stratum of their own. Ids are unique; rows that repeat the id at the
    boundary go to the training side together.
    """
    cuts = written(split_points(df, key, stratum, fraction, most), "cuts").withColumnRenamed(
        "stratum", "_stratum"
    )
    return (
        df.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("is_train", F.coalesce(_order_key(key) <= F.col("cut"), F.lit(False)))
        .drop("_stratum", "cut")
    )
