"""Access: the nearest facility of each cell, the mean way of a person, before and after, and simple baselines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.durable import durable
from sitewise.functions.geo import EARTH_M, haversine_m, minutes
from sitewise.operators.grid import Grid
from sitewise.operators.nearest import MOST_POINTS, small_tree, with_nearest

#: Levels of the pyramid of buckets at most; 2^20 buckets a side at the finest.
MOST_LEVELS = 20


def travel_times(sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """(src, dst, minutes) of all pairs, in long form. sources: src, lon, lat; destinations: dst, lon, lat.

    The matrix is what is asked for, so its rows grow with the product of the
    two tables; ``nearest_times`` finds the nearest without it.
    """
    far = destinations.select("dst", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    return sources.join(far, how="cross").select("src", "dst", minutes(haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))).alias("minutes"))


def _least_distance(lon: Column, lat: Column, west: Column, south: Column, size: Column, lon_step: float, lat_step: float) -> Column:
    """Metres from a point to a bucket, at least; with a margin for rounding."""
    def gap(value: Column, low: Column, step: float) -> Column:
        return F.greatest(low - value, value - (low + size * step), F.lit(0.0))

    up = F.radians(gap(lat, south, lat_step)) * EARTH_M
    turn = F.least(F.radians(gap(lon, west, lon_step)), F.lit(math.pi / 2))
    side = F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(turn))) * EARTH_M
    return F.greatest(up, side) * (1 - 1e-9) - 1e-3


def nearest_times(cells: DataFrame, facilities: DataFrame, grid: Grid, *, most_points: int = MOST_POINTS) -> DataFrame:
    """cell_id, minutes: the way from each cell's centre to its nearest facility; null if there are no facilities.

    Up to ``most_points`` different places are broadcast as a tree, and cells neither move nor meet in a shuffle; more go through
    a pyramid of joins.
    """
    placed = facilities.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").select("lon", "lat")
    if (tree := small_tree(placed, most_points)) is None:
        return nearest_by_pyramid(cells, placed, grid)
    found = with_nearest(cells.select("cell_id", "center_lon", "center_lat"), tree, lon="center_lon", lat="center_lat")
    return found.select("cell_id", minutes(haversine_m(F.col("center_lon"), F.col("center_lat"), F.col("_lon"), F.col("_lat"))).alias("minutes"))


def nearest_by_pyramid(cells: DataFrame, facilities: DataFrame, grid: Grid) -> DataFrame:
    """The same for facilities of any number.

    Facilities fall into buckets of the grid's size, and buckets into a pyramid.
    From its top down each cell keeps the buckets that can still hold its
    nearest one: a facility known in any bucket bounds the distance, and what is
    farther at least is dropped. Of the facilities only bucket counts are
    shuffled; in the end each is measured against the few cells that ask for
    its bucket.
    """
    west, south = grid.bbox[0], grid.bbox[1]
    row, col = F.floor((F.col("lat") - south) / grid.lat_step), F.floor((F.col("lon") - west) / grid.lon_step)
    placed = facilities.where("lon is not null and lat is not null").select("lon", "lat", row.alias("_r"), col.alias("_c"))
    buckets = durable(placed.groupBy("_r", "_c").agg(F.min(F.struct("lon", "lat")).alias("_one")))
    reach = buckets.agg(F.min("_r"), F.max("_r"), F.min("_c"), F.max("_c")).collect()[0]
    targets = cells.select("cell_id", "center_lon", "center_lat")
    if reach[0] is None:
        return targets.select("cell_id", F.lit(None).cast("double").alias("minutes"))
    r0, c0 = reach[0], reach[2]
    levels = min(MOST_LEVELS, max(reach[1] - r0 + 1, reach[3] - c0 + 1).bit_length())
    shifted = buckets.select((F.col("_r") - r0).alias("_r"), (F.col("_c") - c0).alias("_c"), "_one")

    def at(level: int) -> DataFrame:
        size = 2**level
        return shifted.groupBy(F.floor(F.col("_r") / size).alias("_r"), F.floor(F.col("_c") / size).alias("_c")).agg(F.min("_one").alias("_one"))

    def pruned(asked: DataFrame, level: int) -> DataFrame:
        size = 2**level
        lon, lat = F.col("center_lon"), F.col("center_lat")
        least = _least_distance(
            lon, lat, west + (F.col("_c") * size + c0) * grid.lon_step, south + (F.col("_r") * size + r0) * grid.lat_step,
            F.lit(float(size)), grid.lon_step, grid.lat_step,
        )
        known = haversine_m(lon, lat, F.col("_one.lon"), F.col("_one.lat"))
        limited = asked.withColumn("_limit", F.min(known).over(Window.partitionBy("cell_id")))
        return limited.where(least <= F.col("_limit")).select("cell_id", "center_lon", "center_lat", "_r", "_c")

    # The top has one bucket, or a few where the pyramid's height is cut.
    whole = at(levels)
    asked = pruned(targets.join(F.broadcast(whole), how="cross"), levels)
    for level in range(levels - 1, -1, -1):
        below = at(level).withColumns({"_pr": F.floor(F.col("_r") / 2), "_pc": F.floor(F.col("_c") / 2)})
        up = asked.select("cell_id", "center_lon", "center_lat", F.col("_r").alias("_pr"), F.col("_c").alias("_pc"))
        asked = pruned(up.join(below, ["_pr", "_pc"]).drop("_pr", "_pc"), level)
    wanted = asked.select("cell_id", "center_lon", "center_lat", (F.col("_r") + r0).alias("_r"), (F.col("_c") + c0).alias("_c"))
    measured = placed.join(wanted, ["_r", "_c"]).select("cell_id", haversine_m(F.col("center_lon"), F.col("center_lat"), F.col("lon"), F.col("lat")).alias("_m"))
    return measured.groupBy("cell_id").agg(minutes(F.min("_m")).alias("minutes"))


def mean_access_time(cells: DataFrame, facilities: DataFrame, grid: Grid) -> DataFrame:
    """One row, ``minutes``: the mean over people; over cells if nobody lives there. Null populations weigh nothing."""
    times = nearest_times(cells, facilities, grid)
    joined = cells.select("cell_id", F.coalesce("population", F.lit(0)).alias("_pop")).join(times, "cell_id")
    people = F.sum("_pop")
    return joined.agg(F.when(people == 0, F.avg("minutes")).otherwise(F.try_divide(F.sum(F.col("minutes") * F.col("_pop")), people)).alias("minutes"))


def before_after(cells: DataFrame, facilities: DataFrame, recommended: DataFrame, grid: Grid, *, old_times: DataFrame | None = None) -> DataFrame:
    """One row: before, after, improvement in minutes, when the recommended places join the facilities.

    The old facilities are searched once, or not at all where ``old_times`` (cell_id, minutes) has the ways to them: a cell's new way
    is the lesser of the old one and the way to the nearest new place.
    """
    new = recommended.select(F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"))
    old_times = (nearest_times(cells, facilities, grid) if old_times is None else old_times).withColumnRenamed("minutes", "_old")
    new_times = nearest_times(cells, new, grid).withColumnRenamed("minutes", "_new")
    joined = cells.select("cell_id", F.coalesce("population", F.lit(0)).alias("_pop")).join(old_times, "cell_id").join(new_times, "cell_id", "left")
    timed = joined.withColumn("_after", F.least("_old", "_new"))

    def mean(column: str) -> Column:
        return F.when(F.sum("_pop") == 0, F.avg(column)).otherwise(F.try_divide(F.sum(F.col(column) * F.col("_pop")), F.sum("_pop")))

    return timed.agg(mean("_old").alias("before"), mean("_after").alias("after")).withColumn("improvement", F.col("before") - F.col("after"))


def baseline_placement(cells: DataFrame, n: int, method: str = "population_density", *, seed: int = 0) -> DataFrame:
    """n cells to compare with: at random (the order of an MD5 of id and seed), or else those with most people, ties by id.

    Random placement of more cells than there are is an error.
    """
    if method == "random":
        if cells.limit(n).count() < n:
            raise ValueError(f"fewer than {n} cells")
        order = [F.md5(F.concat(F.col("cell_id"), F.lit(f"|{seed}"))), F.col("cell_id")]
    else:
        order = [F.desc_nulls_last("population"), F.col("cell_id")]
    return cells.orderBy(*order).limit(n).select("cell_id", "center_lon", "center_lat")


def validation_report(cells: DataFrame, facilities: DataFrame, recommended: DataFrame, grid: Grid, *, baseline: str = "population_density") -> DataFrame:
    """Two rows, scenario, before, after, improvement: the model's places and as many of the baseline."""
    n = recommended.count()
    points = baseline_placement(cells, n, baseline)
    # Searched once for both.
    old_times = durable(nearest_times(cells, facilities, grid))
    model = before_after(cells, facilities, recommended, grid, old_times=old_times).withColumn("scenario", F.lit("model"))
    naive = before_after(cells, facilities, points, grid, old_times=old_times).withColumn("scenario", F.lit(f"baseline_{baseline}"))
    return model.unionByName(naive).select("scenario", "before", "after", "improvement")


def validation_flags(report: DataFrame) -> DataFrame:
    """One row: whether the model brings facilities nearer, and whether by at least as much as the baseline."""
    def of(column: str, scenario: Column) -> Column:
        return F.max(F.when(scenario, F.col(column)))

    model, naive = F.col("scenario") == "model", F.col("scenario").startswith("baseline")
    return report.agg(
        (of("after", model) < of("before", model)).alias("nearer"), (of("improvement", model) >= of("improvement", naive)).alias("better_than_baseline")
    )
