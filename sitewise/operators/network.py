"""Ways over a network: shortest paths from many places at once, in rounds over an edge table.

A round takes the nodes that have come nearer in the last one, the frontier, over their edges and keeps what beats the known
minutes. Edges lie in buckets by their first node, so a round moves only the frontier to them. As soon as all targets are
reached, no way of as many minutes as the farthest of them needs to go on; the search ends when nothing has come nearer.
Edges have no negative minutes; a node without a way has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.durable import delete_folder, forget, new_folder, written
from sitewise.functions.geo import haversine_m, minutes
from sitewise.operators.nearest import small_tree, with_nearest


@contextmanager
def _bucketed(edges: DataFrame) -> Iterator[DataFrame]:
    """The edges as a table of buckets by their first node, for as long as it is read."""
    spark = edges.sparkSession
    name, folder = f"edges_{uuid.uuid4().hex}", new_folder(spark, "edges")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = edges.where("minutes is not null and a is not null and b is not null").groupBy("a", "b").agg(F.min("minutes").alias("minutes"))
    least.repartition(buckets, "a").write.bucketBy(buckets, "a").sortBy("a").option("path", folder).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        delete_folder(spark, folder)


def shortest(edges: DataFrame, start: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """src, node, minutes: the least minutes from each source to each node it reaches; only to the ``targets`` (node) if these are given.

    edges: a, b, minutes, one way each. start: src, node, minutes, with any number of nodes for a source: their least way counts.
    """
    kind = "src {}, node {}, minutes double".format(*(start.schema[c].dataType.simpleString() for c in ("src", "node")))
    own = start.where("minutes is not null").groupBy("src", "node").agg(F.min("minutes").cast("double").alias("minutes"))
    with _bucketed(edges) as table:
        known = written(own.select("src", "node", "minutes"), "known")
        frontier, bound = known, None
        asked = written(targets.select("node").distinct(), "targets") if targets is not None else None
        wanted = asked.count() * known.select("src").distinct().count() if asked is not None else 0
        while True:
            if asked is not None:
                reached = known.join(asked, "node").agg(F.count(F.lit(1)).alias("n"), F.max("minutes").alias("far")).first()
                bound = reached["far"] if wanted and reached["n"] == wanted else None
            going = frontier if bound is None else frontier.where(F.col("minutes") < bound)
            steps = going.join(table, going["node"] == table["a"]).select("src", F.col("b").alias("node"), (going["minutes"] + table["minutes"]).alias("minutes"))
            if bound is not None:
                steps = steps.where(F.col("minutes") < bound)
            least = steps.groupBy("src", "node").agg(F.min("minutes").alias("minutes"))
            old = known.withColumnRenamed("minutes", "_old")
            nearer = written(least.join(old, ["src", "node"], "left").where("_old is null or minutes < _old").select("src", "node", "minutes"), "nearer")
            if frontier is not known:
                forget(frontier)
            frontier = nearer
            if nearer.isEmpty():
                break
            merged = written(known.unionByName(nearer).groupBy("src", "node").agg(F.min("minutes").alias("minutes")), "known")
            forget(known)
            known = merged
        found = written(known.join(asked, "node", "left_semi") if asked is not None else known, "ways").select("src", "node", "minutes")
        forget(known, frontier, *([asked] if asked is not None else []))
    return found.to(start.sparkSession.createDataFrame([], kind).schema)


def _snapped(places: DataFrame, nodes: DataFrame, lon: str, lat: str) -> DataFrame:
    """The places with their nearest ``node`` and the straight way to it in minutes, ``way``."""
    placed = nodes.where("lon is not null and lat is not null").select("node", "lon", "lat")
    if (tree := small_tree(placed)) is None:
        raise ValueError("a network has from one to a million different places")
    first = placed.groupBy(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).agg(F.min("node").alias("node"))
    near = with_nearest(places, tree, lon=lon, lat=lat)
    return near.join(F.broadcast(first), ["_lon", "_lat"]).withColumn("way", minutes(haversine_m(F.col(lon), F.col(lat), F.col("_lon"), F.col("_lat")))).drop("_lon", "_lat")


def network_times(cells: DataFrame, facilities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, minutes: from each cell's centre straight to its nearest node, over the network, and straight to the facility that is then nearest; null without a way.

    nodes: node, lon, lat. edges: a, b, minutes, one way each, gone from facilities to cells.
    """
    starts = _snapped(facilities.where("lon is not null and lat is not null").select("lon", "lat"), nodes, "lon", "lat")
    ends = written(_snapped(cells.select("cell_id", "center_lon", "center_lat"), nodes, "center_lon", "center_lat").select("cell_id", "node", "way"), "ends")
    start = starts.select(F.lit(0).alias("src"), "node", F.col("way").alias("minutes"))
    found = shortest(edges, start, ends.select("node")).select("node", "minutes")
    total: Column = F.col("minutes") + F.col("way")
    return ends.join(found, "node", "left").select("cell_id", total.alias("minutes"))


def network_matrix(sources: DataFrame, destinations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, minutes) over the network, for all pairs that have a way. sources: src, lon, lat; destinations: dst, lon, lat."""
    starts = _snapped(sources.select("src", "lon", "lat"), nodes, "lon", "lat")
    ends = written(_snapped(destinations.select("dst", "lon", "lat"), nodes, "lon", "lat").select("dst", "node", "way"), "ends")
    found = shortest(edges, starts.select("src", "node", F.col("way").alias("minutes")), ends.select("node"))
    return found.join(ends, "node").select("src", "dst", (F.col("minutes") + F.col("way")).alias("minutes"))
