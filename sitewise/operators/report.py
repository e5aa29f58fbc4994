"""What a map and the figures show, as tables, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.geo import rectangle_wkb
from sitewise.operators.grid import Grid
from sitewise.operators.tiles import page
from sitewise.sources.geofile import write_geometries

# Colours and labels of the two kinds of facility, the words of a marker, a line of the legend, and a circle's least radius and what a score of 1 adds.
TYPE_COLORS = {"public": "#0F6E56", "private": "#993C1D"}
TYPE_LABELS = {"public": "государственная", "private": "частная"}

POPUP = "<b>%s</b><br>Тип: %s<br>Ценность: %.2f"
LEGEND_LINE = "<span style='color:%s'>&#9679;</span> %s (%d)"
RADIUS, RADIUS_BY_SCORE = 8, 6


def _by_type(table: dict[str, str], kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]


def markers(recommended: DataFrame) -> DataFrame:
    """cell_id, lon, lat, color, radius, popup of each recommended place."""
    kind = F.col("facility_type")
    popup = F.format_string(POPUP, "cell_id", _by_type(TYPE_LABELS, kind), "best_score")
    return recommended.select(
        "cell_id", F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"), _by_type(TYPE_COLORS, kind).alias("color"),
        (RADIUS + RADIUS_BY_SCORE * F.col("best_score")).alias("radius"), popup.alias("popup"),
    )


def legend(recommended: DataFrame) -> DataFrame:
    """A row for each kind, chosen or not: facility_type, label, color, n."""
    counts = recommended.groupBy("facility_type").agg(F.count(F.lit(1)).alias("_n"))
    kinds = recommended.sparkSession.createDataFrame([(k, TYPE_LABELS[k], TYPE_COLORS[k]) for k in TYPE_COLORS], "facility_type string, label string, color string")
    return kinds.join(counts, "facility_type", "left").select("facility_type", "label", "color", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def geojson_features(cells: DataFrame, properties: tuple[str, ...] = ("cell_id", "population", "existing_clinics", "wealth_score")) -> DataFrame:
    """cell_id, feature: each cell as a GeoJSON polygon with these of its columns."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return cells.select("cell_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(cells: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON, a feature a line, written by the tasks."""
    geojson_features(cells).select("feature").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, *, files: int | None = 1) -> None:
    """CSV with a header in UTF-8, without rings; ``files`` files, one for a table to be read by people, None for a file a task."""
    flat = df.drop("ring", "geometry")
    (flat if files is None else flat.coalesce(files)).write.mode("overwrite").option("header", True).csv(path)


def with_geometry(cells: DataFrame) -> DataFrame:
    """Adds ``geometry``: each cell's rectangle as well-known binary."""
    return cells.withColumn("geometry", rectangle_wkb("x0", "y0", "x1", "y1"))


def save_cells(cells: DataFrame, path: str) -> None:
    """A geometry file with each cell's edges and its rectangle as well-known binary."""
    write_geometries(with_geometry(cells), path)


def legend_lines(recommended: DataFrame) -> DataFrame:
    """One row, ``legend``: a line for each kind."""
    return legend(recommended).agg(F.array_join(F.sort_array(F.collect_list(F.format_string(LEGEND_LINE, "color", "label", "n"))), "<br>").alias("legend"))


def tiled_page(recommended: DataFrame, grid: Grid, *, tiles: str, base: str = "") -> DataFrame:
    """One row, ``html``: a page of the recommended places over a background, with the outlines and numbers of the tiles in view."""
    return page(markers(recommended), legend_lines(recommended), grid, tiles=tiles, base=base)


def map_page(recommended: DataFrame, cells: DataFrame) -> DataFrame:
    """One row, ``html``: a page with the recommended places as circles of their colour, size and words, and a legend.

    It holds as many rows as the budget of sites; cell outlines stay in their GeoJSON file.
    """
    bounds = cells.agg(((F.min("x0") + F.max("x1")) / 2).alias("lon"), ((F.min("y0") + F.max("y1")) / 2).alias("lat"))
    made = markers(recommended).agg(F.to_json(F.sort_array(F.collect_list(F.struct("cell_id", "lon", "lat", "color", "radius", "popup")))).alias("markers"))
    lines = legend_lines(recommended)
    whole = F.format_string(
        "<!doctype html><meta charset='utf-8'><div id='legend'>%s</div><script>const centre=[%.6f,%.6f];const markers=%s;</script>", "legend", "lat", "lon", "markers"
    )
    return bounds.join(F.broadcast(made), how="cross").join(F.broadcast(lines), how="cross").select(whole.alias("html"))
