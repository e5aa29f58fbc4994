"""The grid: upright cells of equal steps in degrees, row after row from the south-west corner."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.geo import METERS_PER_DEGREE

#: Edges of one axis travel in a one-row table; so many are 1.6 MB.
MOST_EDGES = 200_000


@dataclass(frozen=True)
class Grid:
    """bbox: min_lon, min_lat, max_lon, max_lat. The last row and column may reach beyond it."""

    bbox: tuple[float, float, float, float]
    cell_size_m: float
    id_prefix: str = "cell_"

    @property
    def lat_step(self) -> float:
        return self.cell_size_m / METERS_PER_DEGREE

    @property
    def lon_step(self) -> float:
        middle = (self.bbox[1] + self.bbox[3]) / 2
        return self.cell_size_m / (METERS_PER_DEGREE * math.cos(math.radians(middle)))

    @staticmethod
    def _edges(low: float, high: float, step: float) -> list[float]:
        """Lower edges and the last upper one, by adding the step again and again: neighbours share an edge to the last bit."""
        if (high - low) / step > MOST_EDGES:
            raise ValueError(f"more than {MOST_EDGES} cells on one axis")
        edges = [low]
        while edges[-1] < high:
            edges.append(edges[-1] + step)
        return edges

    @cached_property
    def lat_edges(self) -> list[float]:
        return self._edges(self.bbox[1], self.bbox[3], self.lat_step)

    @cached_property
    def lon_edges(self) -> list[float]:
        return self._edges(self.bbox[0], self.bbox[2], self.lon_step)

    @property
    def rows(self) -> int:
        return len(self.lat_edges) - 1

    @property
    def columns(self) -> int:
        return len(self.lon_edges) - 1

    def with_edges(self, df: DataFrame) -> DataFrame:
        """Adds ``_lats`` and ``_lons``, the two axes' edges, from a broadcast row."""
        one = df.sparkSession.createDataFrame([(0, self.lat_edges, self.lon_edges)], "_one int, _lats array<double>, _lons array<double>")
        return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")

    def cell_id(self, row: Column, column: Column) -> Column:
        return F.format_string(f"{self.id_prefix}%06d", row.cast("bigint") * self.columns + column)

    def guess_row(self, lat: Column) -> Column:
        """The row by division: the true one, or one beside it on an edge."""
        return F.floor((lat - self.bbox[1]) / self.lat_step)

    def guess_column(self, lon: Column) -> Column:
        return F.floor((lon - self.bbox[0]) / self.lon_step)


def build_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """cell_id, row, col, x0, y0, x1, y1, center_lon, center_lat of each cell; made on the executors."""
    n = grid.rows * grid.columns
    at = spark.range(n).select(F.floor(F.col("id") / grid.columns).cast("int").alias("row"), (F.col("id") % grid.columns).cast("int").alias("col"))
    edged = grid.with_edges(at)
    x0, y0 = F.get("_lons", F.col("col")), F.get("_lats", F.col("row"))
    return edged.select(
        grid.cell_id(F.col("row"), F.col("col")).alias("cell_id"), "row", "col", x0.alias("x0"), y0.alias("y0"),
        (x0 + grid.lon_step).alias("x1"), (y0 + grid.lat_step).alias("y1"),
        (x0 + grid.lon_step / 2).alias("center_lon"), (y0 + grid.lat_step / 2).alias("center_lat"),
    )


def locate(points: DataFrame, grid: Grid, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The points strictly inside a cell, with its ``row`` and ``col``; points on an edge or outside go.

    The cell is worked out by division and put right by the stored edges, so no
    join and no shuffle is needed, whatever the number of points.
    """

    def place(value: Column, guess: Column, edges: Column) -> Column:
        return F.get(F.filter(F.transform(F.sequence(guess - 1, guess + 1), lambda k: k.cast("int")), lambda k: (value > F.get(edges, k)) & (value < F.get(edges, k + 1))), 0)

    edged = grid.with_edges(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()))
    placed = edged.withColumns(
        {
            "row": place(F.col(lat), grid.guess_row(F.col(lat)), F.col("_lats")),
            "col": place(F.col(lon), grid.guess_column(F.col(lon)), F.col("_lons")),
        }
    )
    return placed.where("row is not null and col is not null").drop("_lats", "_lons")
