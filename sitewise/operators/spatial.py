"""Spatial joins with the grid: facilities per cell, cell contexts, population by share of area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.text import CONTEXT_HEAD, CONTEXT_NONE, label
from sitewise.operators.grid import Grid, locate
from sitewise.operators.overlay import population_sums


def count_facilities(cells: DataFrame, facilities: DataFrame, grid: Grid) -> DataFrame:
    """The cells with ``existing_clinics``, 0 where there are none. Only the counts cross the network."""
    counts = locate(facilities, grid).groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n"))
    return cells.join(counts, ["row", "col"], "left").withColumn("existing_clinics", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")


def contexts(cells: DataFrame, facilities: DataFrame, grid: Grid) -> DataFrame:
    """cell_id, context: the number of facilities and the numbers by kind, the commonest first, then by name.

    Facilities without a kind count in the total only. Kinds are counted before
    they meet in a cell's list.
    """
    kinds = locate(facilities, grid).groupBy("row", "col", "amenity").agg(F.count(F.lit(1)).alias("n"))
    listed = F.collect_list(F.when(F.col("amenity").isNotNull(), F.struct((-F.col("n")).alias("order"), F.col("amenity"))))
    each = F.transform(F.sort_array("_kinds"), lambda k: F.concat(label(k["amenity"]), F.lit(": "), (-k["order"]).cast("string")))
    whole = kinds.groupBy("row", "col").agg(F.sum("n").alias("_total"), listed.alias("_kinds"))
    sentence = F.concat(F.lit(CONTEXT_HEAD), F.col("_total").cast("string"), F.lit(" ("), F.array_join(each, ", "), F.lit(")."))
    found = whole.select("row", "col", sentence.alias("_context"))
    return cells.join(found, ["row", "col"], "left").select("cell_id", F.coalesce("_context", F.lit(CONTEXT_NONE)).alias("context"))


def population_per_cell(cells: DataFrame, hexagons: DataFrame, grid: Grid) -> DataFrame:
    """The cells with ``population``: sums of the pieces' shares, rounded half to even, 0 where there are none."""
    sums = population_sums(hexagons, grid)
    whole = F.bround(F.coalesce("people", F.lit(0.0)), 0).cast("bigint")
    return cells.join(sums, ["row", "col"], "left").withColumn("population", whole).drop("people")
