"""Hotspots by buffering: places with enough incidents within a distance, joined where their buffers reach one another.

Incidents are first summed by site, the nearest point of a lattice of 1/``sites_per_degree`` degree (11 m by
default, about the precision of a reported position), so a crowded place is one row. Sites are grouped by
buckets narrower than the buffer, and most work is done by groups. A site is *core* when its buffer holds
``min_incidents`` or more, itself included. Core sites within each other's buffers are one hotspot, named by its least site; another site within the buffer of core sites belongs to the
hotspot of the nearest one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.geo import EARTH_RADIUS_M, METERS_PER_DEGREE, MICRO, bucket_of, haversine_m, micro_degrees, short_way
from kerbwise.operators.radius import radius_join
from kerbwise.session import written

BUFFER_M = 500.0
SITES_PER_DEGREE = 10_000  # a divisor of a million


def sites(df: DataFrame, per_degree: int = SITES_PER_DEGREE) -> DataFrame:
    """Sums of the incidents of each site, and its position; incidents without a position have none.

    ``lat_sum`` is in micro-degrees, ``east_sum`` in micro-degrees east of the site, so that sums hold at the 180th meridian.
    """
    around = 360 * per_degree
    own = F.pmod(F.floor((F.col("longitude") + 180.0) * per_degree + 0.5), F.lit(around)) * (MICRO // per_degree) - 180 * MICRO
    row = F.floor((F.col("latitude") + 90.0) * per_degree + 0.5)
    column = F.pmod(F.floor((F.col("longitude") + 180.0) * per_degree + 0.5), F.lit(around))
    summed = (
        df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy((row * around + column).alias("site"))
        .agg(
            F.count("*").alias("n"),
            F.count("severity").alias("n_severity"),
            F.sum("severity").alias("severity_sum"),
            F.count_if(F.col("severity") == 3).alias("fatal"),
            F.sum(micro_degrees(F.col("latitude"))).alias("lat_sum"),
            F.sum(short_way((micro_degrees(F.col("longitude")) - own) / MICRO) * MICRO).cast("long").alias("east_sum"),
        )
    )
    return summed.withColumns(
        {
            "latitude": F.floor(F.col("site") / around) / per_degree - 90.0,
            "longitude": F.pmod("site", F.lit(around)) / per_degree - 180.0,
        }
    )


def _pointers(parents: DataFrame) -> DataFrame:
    """``(node, top)``: each node's pointers (node -> parent < node) followed to their end, twice as far each round."""
    tops = written(parents.select("node", F.col("parent").alias("top")), "tops")
    while True:
        onward = tops.select(F.col("node").alias("top"), F.col("top").alias("further"))
        next_tops = written(
            tops.join(onward, "top", "left").select("node", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")),
            "tops",
        )
        tops = next_tops.select("node", "top")
        if next_tops.where("moved").isEmpty():
            return tops


def least_labels(pairs: DataFrame) -> DataFrame:
    """``(node, label)`` of every node in ``pairs`` (a, b), both directions given: the least node that pairs lead to.

    Each round every node that has a lesser neighbour points to its least one, pointers are followed to their ends, and
    the pairs between ends remain for the next round.
    """
    links = written(pairs.where("a != b"), "links")
    labels = written(links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not links.isEmpty():
        parents = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        tops = _pointers(parents)
        labels = written(
            labels.join(tops.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("top", "label").alias("label")),
            "labels",
        )

        def moved(df: DataFrame, end: str) -> DataFrame:
            to = tops.select(F.col("node").alias(end), "top")
            return df.join(to, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")

        links = written(moved(moved(links, "a"), "b").where("a != b").distinct(), "links")
    return labels


#: Side of the buckets that sites are grouped by, as a share of the buffer: the diagonal stays below it.
BUCKET_SHARE = 0.7
#: Widest group, in degrees, whose extent is bounded by its box.
WIDEST_GROUP = 10.0


def _grouped(placed: DataFrame, buffer_m: float, min_incidents: int) -> DataFrame:
    """The sites with their ``group`` and whether it is ``dense``.

    Sites of one group are all within the buffer of each other: those of a bucket, if the box around them shows it, else (near
    the poles) each site by itself. So the sites of a group with ``min_incidents`` are core without a search, and any
    other group has fewer sites than that, or one. A group is named by its least site.
    """
    bucketed = placed.select(
        "site", "n", "latitude", "longitude",
        bucket_of(F.col("latitude"), F.col("longitude"), BUCKET_SHARE * buffer_m / METERS_PER_DEGREE).alias("bucket"),
    )
    boxes = bucketed.groupBy("bucket").agg(
        F.sum("n").alias("inside"), F.min("site").alias("least"),
        *[f(c).alias(f"{name}_{c}") for c in ("latitude", "longitude") for name, f in (("low", F.min), ("high", F.max))],
    )
    tall, wide = (F.col(f"high_{c}") - F.col(f"low_{c}") for c in ("latitude", "longitude"))
    equatorward = F.greatest(F.lit(0.0), F.greatest(F.col("low_latitude"), -F.col("high_latitude")))
    half_lat, half_lon = F.sin(F.radians(tall) / 2.0), F.sin(F.radians(wide) / 2.0) * F.cos(F.radians(equatorward))
    most = (1.0 - 1e-9) * math.sin(min(buffer_m / (2.0 * EARTH_RADIUS_M), math.pi / 2.0)) ** 2  # of the squared half chord
    tight = (half_lat * half_lat + half_lon * half_lon <= most) & (F.greatest(tall, wide) <= WIDEST_GROUP)
    groups = boxes.select("bucket", "inside", "least", tight.alias("tight"))
    return bucketed.join(groups, "bucket").select(
        "site", "n", "latitude", "longitude", F.when(F.col("tight"), F.col("least")).otherwise(F.col("site")).alias("group"),
        (F.when(F.col("tight"), F.col("inside")).otherwise(F.col("n")) >= min_incidents).alias("dense"),
    )


def _centers(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.col("latitude").alias("center_lat"), F.col("longitude").alias("center_lon"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _core_groups(core: DataFrame, buffer_m: float) -> DataFrame:
    """``(group, label)``: the least group that each group of core sites is joined with.

    Core sites of a group are within each other's buffers, so groups are joined, not sites. First by the outermost sites of
    each alone, which settles crowded places; then all sites are compared, of groups near each
    other that are still apart. Neither list of pairs grows with the number of sites in a group.
    """
    lat, lon = F.struct("latitude", "longitude", "site"), F.struct("longitude", "latitude", "site")
    boxes = written(
        core.groupBy("group").agg(
            F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east")
        ),
        "core-groups",
    )
    outer = written(
        boxes.select("group", F.explode(F.array(*[
            F.struct(F.col(f"{side}.latitude").alias("latitude"), F.col(f"{side}.longitude").alias("longitude"))
            for side in ("south", "north", "west", "east")
        ])).alias("p")).select("group", "p.latitude", "p.longitude").distinct(),
        "outer-sites",
    )
    touching = radius_join(outer.withColumnRenamed("group", "a"), _centers(outer, F.col("group").alias("b")), buffer_m)
    first = written(
        boxes.select("group").join(
            least_labels(touching.where("a != b").select("a", "b").distinct()).withColumnRenamed("node", "group"), "group", "left"
        ).select("group", F.coalesce("label", "group").alias("label")),
        "group-labels",
    )
    middles = written(
        boxes.join(first, "group").select(
            "group", "label", ((F.col("south.latitude") + F.col("north.latitude")) / 2.0).alias("latitude"),
            ((F.col("west.longitude") + F.col("east.longitude")) / 2.0).alias("longitude"),
        ),
        "group-middles",
    )
    # a middle is at most about half the buffer away from its sites
    apart = radius_join(
        middles.withColumnsRenamed({"group": "a", "label": "label_a"}),
        _centers(middles, F.col("group").alias("b"), F.col("label").alias("label_b")), 2.01 * buffer_m,
    ).where("label_a < label_b").select("a", "b", "label_a", "label_b")
    one, other = (
        core.select(F.col("group").alias(g), F.col("latitude").alias(f"lat_{g}"), F.col("longitude").alias(f"lon_{g}")) for g in ("a", "b")
    )
    meters = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    met = (
        written(apart, "groups-apart").join(one, "a").join(other, "b").where(meters <= buffer_m)
        .select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    )
    last = least_labels(_both_ways(written(met, "groups-met")))
    return first.join(last.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "left").select(
        "group", F.coalesce("joined", "label").alias("label")
    )


def site_hotspots(placed: DataFrame, buffer_m: float, min_incidents: int) -> DataFrame:
    """``(site, hotspot, is_core)`` of the sites (a written table) that belong to a hotspot.

    Only sites outside dense groups, few to a bucket, are compared with the sites around them, and no pairs of
    sites are kept: time and disk grow with the sites, not with the pairs within the buffer.
    """
    grouped = written(_grouped(placed, buffer_m, min_incidents), "grouped-sites")
    loose = written(grouped.where(~F.col("dense")), "loose-sites")
    around = radius_join(grouped.select("n", "latitude", "longitude"), _centers(loose, "site"), buffer_m)
    more = around.groupBy("site").agg(F.sum("n").alias("inside")).where(F.col("inside") >= min_incidents).select("site")
    core = grouped.where("dense").drop("n", "dense").unionByName(
        loose.drop("n", "dense").join(written(more, "core-sites"), "site", "left_semi")
    )
    core = written(core, "core")
    # a group is named by its least core site from here on
    least = core.groupBy("group").agg(F.min("site").alias("least"))
    core = written(core.join(least, "group").drop("group").withColumnRenamed("least", "group"), "named-core")
    named = written(
        core.join(_core_groups(core, buffer_m), "group").select("site", "latitude", "longitude", F.col("label").alias("hotspot")), "hotspots"
    )
    outside = loose.join(named.select("site"), "site", "left_anti")
    border = (
        radius_join(named.select("hotspot", "latitude", "longitude"), _centers(outside, "site"), buffer_m)
        .groupBy("site").agg(F.min(F.struct("distance_m", "hotspot"))["hotspot"].alias("hotspot"))
    )
    return named.select("site", "hotspot", F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False)))


def buffered_hotspots(
    df: DataFrame, buffer_m: float = BUFFER_M, min_incidents: int = fixed.GRID_MIN_INCIDENTS, per_degree: int = SITES_PER_DEGREE
) -> DataFrame:
    """Figures of each hotspot: sites, incidents, severity and the mean position."""
    around, unit = 360 * per_degree, MICRO // per_degree
    placed = written(sites(df, per_degree), "sites")
    member = placed.join(site_hotspots(placed, buffer_m, min_incidents), "site")
    columns = F.pmod("site", F.lit(around)) - F.pmod("hotspot", F.lit(around))
    short = columns + F.when(columns > around // 2, -around).when(columns < -(around // 2), around).otherwise(0)
    member = member.withColumn("east", F.col("east_sum") + short * unit * F.col("n"))
    center = (F.pmod("hotspot", F.lit(around)) * unit - 180 * MICRO + F.col("east") / F.col("accident_count")) / MICRO
    figures = member.groupBy("hotspot").agg(
        F.count("*").alias("sites"),
        F.count_if("is_core").alias("core_sites"),
        F.sum("n").alias("accident_count"),
        F.try_divide(F.sum("severity_sum"), F.sum("n_severity")).alias("avg_severity"),
        F.sum("fatal").alias("fatal_accidents"),
        (F.sum("lat_sum") / F.sum("n") / MICRO).alias("center_lat"),
        F.sum("east").alias("east"),
    )
    return figures.withColumn("center_lon", short_way(center)).drop("east")
