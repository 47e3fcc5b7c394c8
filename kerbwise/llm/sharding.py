"""A uniform shuffle of rows into shards of exact sizes, by a communication matrix, in DataFrame functions only.

1. Every input partition permutes its rows: they are sorted by a keyed hash of their place. No row moves.
2. The matrix of how many rows go from each partition to each shard is drawn from the law that it has under a
   uniform permutation of all rows, given both sums: halves of the partitions are drawn from their whole,
   shard by shard hypergeometrically, down to single partitions. Rows and columns add up exactly, so shards are of exact size.
3. Each partition deals its first rows to shard 0, the next to shard 1 and so on, and the rows are exchanged.
4. Each shard permutes its rows again: by a second keyed hash, in buckets of bounded size, whose counts give the slots.

The same rows in the same partitions with the same seed give the same result, also where tasks run again: places
are written once before anything follows from them. The law is ``rows``: counts differ by one at most. Equal rows
are shuffled like any others (copies are not kept together); a null text has no bytes; a null id stays null; an empty table
gives an empty result; columns called ``shard`` or ``slot`` are replaced. Texts are never shuffled by :func:`assign`, whatever
their length. One task holds the counts of all partitions (16 bytes each).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.session import written

SHARDS, SEED = 24, 20_240_229
BUCKET_ROWS = 1 << 14
_SPREAD_LEVELS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))


def _walk(steps: Column, ratio: Callable[[Column], Column], wanted: Column) -> Column:
    """Sum of the weights of 1, 2, ... steps from a place of weight 1, and the first step at which it exceeds ``wanted``."""
    zero = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("found"))

    def step(state: Column, i: Column) -> Column:
        def added(weight: Column) -> Column:
            total = state["total"] + weight
            found = F.coalesce(state["found"], F.when(total > wanted, i))
            return F.struct(weight.alias("weight"), total.alias("total"), found.alias("found"))

        return _let(state["weight"] * ratio(i), added)

    return F.aggregate(steps, zero, step)


def hypergeometric(size: Column, marked: Column, drawn: Column, at: Column) -> Column:
    """How many of ``drawn`` out of ``size`` rows are among the ``marked`` ones, by inversion at ``at`` in [0, 1).

    Probabilities are relative to the most likely count and follow from one another by their ratios. Steps
    reach so far (9 standard deviations and 20) that what is left out is below the precision of doubles.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - size)
    high = F.least(drawn, marked)
    rest = (size - marked - drawn).cast("double")

    def inverted(x: Column) -> Column:
        middle, reach = x["middle"], x["reach"]
        ups, downs = _steps(F.least(reach, high - middle)), _steps(F.least(reach, middle - low))

        def up(i: Column) -> Column:  # from middle + i - 1 to middle + i
            k = (middle + i).cast("double")
            return (marked - k + 1) * (drawn - k + 1) / (k * (rest + k))

        def down(i: Column) -> Column:  # from middle - i + 1 to middle - i
            k = (middle - i).cast("double")
            return (k + 1) * (rest + k + 1) / ((marked - k) * (drawn - k))

        none = F.lit(float("inf"))

        def chosen(sums: Column) -> Column:
            wanted = at * (1.0 + sums["up"] + sums["down"])
            above, below = wanted - 1.0, wanted - 1.0 - sums["up"]
            return (
                F.when(wanted < 1.0, middle)
                .when(above < sums["up"], middle + F.coalesce(_walk(ups, up, above)["found"], F.size(ups).cast("long")))
                .otherwise(middle - F.coalesce(_walk(downs, down, below)["found"], F.size(downs).cast("long")))
            )

        return _let(F.struct(_walk(ups, up, none)["total"].alias("up"), _walk(downs, down, none)["total"].alias("down")), chosen)

    share = marked / size
    deviation = F.sqrt(drawn * share * (1 - share) * (size - drawn) / F.greatest(size - 1, F.lit(1)))
    likely = F.floor((drawn + 1.0) * (marked + 1.0) / (size + 2.0)).cast("long")
    start = F.struct(
        F.greatest(low, F.least(high, likely)).alias("middle"), (F.ceil(9 * deviation) + 20).cast("long").alias("reach")
    )
    return F.when(low >= high, high).otherwise(_let(start, inverted))


def _drawn(shards: Column, rows: Column, total: Column, key: list[Column]) -> Column:
    """For ``rows`` rows out of ``total``, of which each shard gets so many: how many of them go to each shard."""
    start = F.struct(rows.alias("rows"), total.alias("total"), F.array().cast("array<bigint>").alias("counts"))

    def next_shard(state: Column, shard: Column) -> Column:
        count = hypergeometric(state["total"], shard, state["rows"], unit(*key, F.size(state["counts"])))
        return _let(
            count,
            lambda n: F.struct(
                (state["rows"] - n).alias("rows"), (state["total"] - shard).alias("total"), F.array_append(state["counts"], n).alias("counts")
            ),
        )

    return F.aggregate(shards, start, next_shard, lambda state: state["counts"])


def matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(part, counts)``: how many of the ``n`` rows of each ``part`` go to each shard."""

    def rows_of(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 0)
    total = rows_of(F.col("parts"))
    even = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0)
    )
    nodes = written(nodes.select("parts", even.alias("counts")), "matrix")
    n_parts = (nodes.agg(F.max(F.size("parts"))).first()[0] or 1) - 1
    for level in range(n_parts.bit_length()):
        if level and level % _SPREAD_LEVELS == 0:
            nodes = written(nodes.repartition(1 << level, F.col("parts")[0]["part"]), "matrix")
        half = F.shiftright(F.size("parts"), 1)
        key = [F.lit(seed), F.col("parts")[0]["part"], F.size("parts")]
        nodes = nodes.withColumn("left", F.slice("parts", 1, half))
        nodes = nodes.withColumn("drawn", _drawn(F.col("counts"), rows_of(F.col("left")), rows_of(F.col("parts")), key))
        split = F.array(
            F.struct(F.col("left").alias("parts"), F.col("drawn").alias("counts")),
            F.struct(
                F.slice("parts", half + 1, F.size("parts") - half).alias("parts"),
                F.zip_with("counts", "drawn", lambda a, b: a - b).alias("counts"),
            ),
        )
        alone = F.array(F.struct("parts", "counts"))
        nodes = nodes.select(F.explode(F.when(F.size("parts") > 1, split).otherwise(alone)).alias("node")).select("node.*")
    return nodes.select(F.col("parts")[0]["part"].alias("part"), "counts")


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with their ``shard`` and their ``slot`` in it, gapless from 0; all columns go through the exchange."""
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    local = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.monotonically_increasing_id().alias("rid"))
    local = local.sortWithinPartitions(F.xxhash64(F.lit(seed), "rid"), "rid").select(
        "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    )
    local = written(local, "permuted")
    counts = written(local.groupBy("part").agg(F.count("*").alias("n")), "part-rows")
    running = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("long"), lambda a, n: a + n))
    ends = written(matrix(counts, shards, seed).select("part", running.alias("ends")), "ends")
    buckets = -(-(counts.agg(F.sum("n")).first()[0] or 1) // (shards * bucket_rows))
    key = F.xxhash64(F.lit(seed + 1), "part", "at")
    dealt = local.join(ends, "part").select(
        "row", "part", "at", key.alias("key"),
        F.size(F.filter("ends", lambda end: end <= F.col("at"))).alias("shard"),
        F.floor(F.shiftrightunsigned(key, 11) * F.lit(2.0**-53) * buckets).alias("bucket"),
    )
    dealt = written(dealt, "dealt")
    filled = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = written(filled.select("shard", "bucket", before.alias("before")), "slots")
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "part", "at"))
    return (
        dealt.withColumn("place", place)
        .join(offsets, ["shard", "bucket"])
        .select("row.*", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document its size, checksum, shard and slot, without moving texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shuffled(rows, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write(rows: DataFrame, path: str) -> None:
    """Write shuffled rows as one folder for each shard, in files whose rows are in the order of their slots."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
