"""Registered queries and their SQL oracles over the driver's tables. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.durable import durable, new_folder
from sitewise.functions.text import PROMPT_HEAD, PROMPT_TAIL, cache_key, prompt
from sitewise.operators import access, estimates, network, pois, report, scores, selection, spatial, stats, tiles
from sitewise.operators.grid import build_grid, locate
from sitewise.plans import inputs
from sitewise.plans.inputs import GRID, HALF_M, SQL, sql_haversine, sql_minutes, sql_scores
from sitewise.plans.siting import optimise
from sitewise.sources.tables import load_cells, load_prices
from sitewise.sources.geofile import edges_of, in_box, read_geometries, write_geometries
from sitewise.sources.geopackage import write_population
from sitewise.sources.overpass import recorded_elements

MODEL = "test-model"
MIN_DISTANCE_M = 1000.0


def _six(column: Column | str, name: str | None = None) -> Column:
    return F.round(column, 6).alias(name or column)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ------------------------------------------------------------------- collect


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.siting_cells(spark, sf_dir).select("cell_id", "population", *[_six(c) for c in ("x0", "y0", "x1", "y1", "center_lon", "center_lat")])


def poi_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nine places: at six these coordinates are ties of rounding.
    return inputs.facilities(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("lon", "lat")})


def poi_exclude_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois.exclude_tag(inputs.facilities(spark, sf_dir), inputs.EXCLUDED_TAGS).select("osm_id", "healthcare")


def poi_exclude_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois.exclude_name(inputs.facilities(spark, sf_dir), inputs.EXCLUDED_NAMES).select("osm_id", "name")


def poi_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All elements, and once more the ways among them, as two overlapping requests return them.
    every = inputs.elements(spark, sf_dir)
    return pois.distinct_elements(every, every.where("type = 'way'")).select("type", "id")


def recorded_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements written as recorded responses of about a thousand each, and read back by the source."""
    elements = inputs.elements(spark, sf_dir)
    part = F.pmod(F.xxhash64("id"), F.lit(elements.count() // 1000 + 1)).alias("_part")
    whole = F.struct(F.collect_list(F.struct("type", "id", "lat", "lon", "center", "tags")).alias("elements"))
    folder = new_folder(spark, "responses")
    elements.groupBy(part).agg(F.to_json(whole).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return pois.flatten(recorded_elements(spark, folder)).withColumns({c: F.round(c, 9) for c in ("lon", "lat")})


def prices_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices written as CSV by all tasks, and read back by the source."""
    folder = new_folder(spark, "prices")
    report.write_csv(inputs.prices(spark, sf_dir).select("cell_id", "price_per_m2"), folder, files=None)
    return load_prices(spark, folder)


def cells_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells file, written with its geometry and read back, edges from both."""
    folder = new_folder(spark, "cells")
    report.save_cells(inputs.siting_cells(spark, sf_dir), folder)
    read = load_cells(spark, folder).withColumn("wkb", edges_of("geometry"))
    return read.select("cell_id", "population", "existing_clinics", _six("x0"), _six("y1"), *[_six(f"wkb.{c}", f"wkb_{c}") for c in ("x0", "y0", "x1", "y1")])


def population_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of all orders in GeoPackage files of the tasks, read back with a filter on their boxes."""
    folder = new_folder(spark, "areas")
    write_population(inputs.hexagons(spark, sf_dir), folder)
    areas = spark.read.format("gpkg").option("path", folder).load()
    west, south, east, north = inputs.METRIC_BOX
    met = areas.where((F.col("max_x") >= west) & (F.col("min_x") <= east) & (F.col("max_y") >= south) & (F.col("min_y") <= north))
    return met.select(_six("population"), F.round("min_x", 3).alias("min_x"), F.round("max_y", 3).alias("max_y"), F.size("ring").alias("corners"))


def geometry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of all orders in a geometry file; those of a box, found by the row groups' statistics, with the edges that their geometry has."""
    folder = new_folder(spark, "geometries")
    write_geometries(report.with_geometry(inputs.squares(spark, sf_dir)), folder, rows_per_group=100, geographic=False)
    read = in_box(read_geometries(spark, folder), *inputs.METRIC_BOX).withColumn("wkb", edges_of("geometry"))
    return read.select("o_orderkey", *[F.round(f"wkb.{c}", 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate(inputs.facilities(spark, sf_dir), GRID).select("osm_id", GRID.cell_id(F.col("row"), F.col("col")).alias("cell_id"))


def cell_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.count_facilities(build_grid(spark, GRID), inputs.facilities(spark, sf_dir), GRID).select("cell_id", "existing_clinics")


def cell_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.contexts(build_grid(spark, GRID), inputs.facilities(spark, sf_dir), GRID)


def population_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.population_per_cell(build_grid(spark, GRID), inputs.hexagons(spark, sf_dir), GRID).select("cell_id", "population")


# ------------------------------------------------------------------ estimate


def prompt_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_context(spark, sf_dir).select("cell_id", cache_key(MODEL, prompt(F.col("context"))).alias("key"))


def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = estimates.with_keys(cell_context(spark, sf_dir), MODEL)
    cached = keyed.where(F.substring("cell_id", -1, 1).isin("0", "1", "2")).select("key")
    return estimates.cache_misses(keyed, cached).select("key")


def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = estimates.parsed(inputs.replies(spark, sf_dir))
    return read.select("doc_id", "wealth_score", "area_character", _six("confidence"), F.col("error").isNull().alias("valid"))


def _fake_model() -> estimates.Model:
    return lambda text: f'{{"wealth_score": {len(text) % 11}, "area_character": "mixed", "confidence": 0.5}}'


def estimate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a model that answers by the length of its prompt, over an empty cache."""
    asked = durable(cell_context(spark, sf_dir))
    return estimates.estimate_cells(asked, _fake_model, model_name=MODEL, cache_path=new_folder(spark, "estimates"), tasks=4)


def estimates_of_arriving_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts written as files and estimated as a stream, some files a batch."""
    folder = new_folder(spark, "arriving")
    cell_context(spark, sf_dir).repartition(6).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("cell_id string, context string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = estimates.estimate_arriving(
        arriving, _fake_model, output_path=f"{folder}/out", checkpoint=f"{folder}/checkpoint", model_name=MODEL, cache_path=f"{folder}/cache", tasks=2, concurrency=4
    )
    query.awaitTermination()
    return estimates.latest_estimates(spark, f"{folder}/out")


def estimates_left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.siting_cells(spark, sf_dir)
    known = cells.where("wealth_score is not null").select("cell_id", "wealth_score", "area_character")
    return estimates.with_estimates(cells.select("cell_id", "population"), known)


def estimated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = estimates_left_merge(spark, sf_dir).where("population > 0")
    return merged.agg(F.count("wealth_score").alias("estimated"), F.count(F.lit(1)).alias("cells"), F.sum("population").alias("population"))


# ------------------------------------------------------------------ optimise


def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    priced = part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), F.lit(3.0).alias("same"))
    return scores.normalize(priced, price_scaled="price", same_scaled="same").select("p_partkey", _six("price_scaled"), _six("same_scaled"))


def need_and_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.with_scores(durable(inputs.siting_cells(spark, sf_dir))).select("cell_id", _six("equity"), _six("profit"))


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.filter_candidates(inputs.siting_cells(spark, sf_dir)).select("cell_id", "area_character", "population", "existing_clinics")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each scale reads the cells once more: they are few, what they are made of isn't.
    return scores.with_facility_type(scores.with_scores(scores.filter_candidates(durable(inputs.siting_cells(spark, sf_dir)))))


def facility_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("cell_id", "facility_type", _six("best_score"))


def weighted_facility_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With profit worth twice and equity half."""
    scored = scores.with_scores(scores.filter_candidates(durable(inputs.siting_cells(spark, sf_dir))))
    return scores.with_facility_type(scored, equity_weight=0.5, profit_weight=2.0).select("cell_id", "facility_type", _six("best_score"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the cells that have facilities."""
    return selection.conflict_pairs(inputs.siting_cells(spark, sf_dir).where("existing_clinics > 0"), GRID, MIN_DISTANCE_M)


def _sites(spark: SparkSession, sf_dir: str, budget: int) -> tuple[DataFrame, DataFrame]:
    cells = durable(inputs.siting_cells(spark, sf_dir))
    return cells, durable(optimise(cells, GRID, budget=budget, min_distance_m=MIN_DISTANCE_M))


def _selected(budget: int) -> Callable[[SparkSession, str], DataFrame]:
    def site_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sites(spark, sf_dir, budget)[1].select("cell_id", _six("center_lon"), _six("center_lat"), "facility_type", _six("best_score"), "optimal")

    return site_selection


# ------------------------------------------------------------------ validate


def travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = build_grid(spark, GRID).select(F.col("cell_id").alias("src"), F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    s = F.col("s_suppkey")
    return _rounded(access.travel_times(cells, supplier.select(s.alias("dst"), (37.55 + s / 100.0).alias("lon"), (55.72 + s / 200.0).alias("lat"))), "minutes")


def nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(access.nearest_times(build_grid(spark, GRID), inputs.facilities(spark, sf_dir), GRID), "minutes")


def network_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each cell over the network to the nearest facility of a kind."""
    nodes, edges = inputs.network(spark, sf_dir)
    clinics = inputs.facilities(spark, sf_dir).where("amenity = 'clinic'").select("lon", "lat")
    return _rounded(network.network_times(build_grid(spark, GRID), clinics, nodes, edges), "minutes")


def access_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(access.mean_access_time(inputs.siting_cells(spark, sf_dir), inputs.facilities(spark, sf_dir), GRID), "minutes")


def baseline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.baseline_placement(inputs.siting_cells(spark, sf_dir), 8).select("cell_id", _six("center_lon"), _six("center_lat"))


def baseline_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.baseline_placement(inputs.siting_cells(spark, sf_dir).where("population > 0"), 8, "random").select("cell_id", _six("center_lon"), _six("center_lat"))


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = durable(inputs.siting_cells(spark, sf_dir))
    found = access.before_after(cells, inputs.facilities(spark, sf_dir).select("lon", "lat"), access.baseline_placement(cells, 8), GRID)
    return found.select(_six("before"), _six("after"), _six("improvement"), (F.col("after") < F.col("before")).alias("nearer"))


def _report(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    cells, chosen = _sites(spark, sf_dir, budget)
    return access.validation_report(cells, inputs.facilities(spark, sf_dir).select("lon", "lat"), chosen, GRID)


def _validated(budget: int) -> Callable[[SparkSession, str], DataFrame]:
    def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_report(spark, sf_dir, budget), "before", "after", "improvement")

    return validation_report


def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.validation_flags(_report(spark, sf_dir, 3))


def validation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stats.bar_facts(_report(spark, sf_dir, 3))
    return _rounded(bars, *bars.columns)


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.spearman(inputs.prices(spark, sf_dir), "wealth_score", "price_per_m2"), "rho")


def spearman_vs_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.prices(spark, sf_dir)
    return _rounded(stats.spearman_vs_price(p.select("cell_id", "wealth_score"), p.select("cell_id", "price_per_m2")), "rho", "p_value")


# -------------------------------------------------------------------- report


def wealth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unit_histogram(inputs.siting_cells(spark, sf_dir).where("existing_clinics > 0"), "wealth_score", 0, 11)


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = durable(scores.with_scores(durable(inputs.siting_cells(spark, sf_dir))))
    parts = [stats.equal_histogram(scored, c).select(F.lit(c).alias("score"), "bin", "n") for c in ("equity", "profit")]
    return parts[0].unionByName(parts[1])


def wealth_by_clinics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.clipped_means(inputs.siting_cells(spark, sf_dir), "existing_clinics", "wealth_score"), "mean_wealth_score")


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_counts(_candidates(spark, sf_dir))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.bounds(inputs.siting_cells(spark, sf_dir).where("existing_clinics > 0"))
    return _rounded(found, *found.columns)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(inputs.siting_cells(spark, sf_dir), F.col("wealth_score"))


def map_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.markers(_sites(spark, sf_dir, 3)[1]), "lon", "lat", "radius")


def map_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.legend(_candidates(spark, sf_dir))


def cell_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners and properties that the outlines hold, read back from their GeoJSON."""
    kind = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<cell_id: string, population: bigint, existing_clinics: bigint, wealth_score: int>"
    read = report.geojson_features(inputs.siting_cells(spark, sf_dir)).select(F.from_json("feature", kind).alias("f"))
    corners = read.select("f.properties.*", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("corner", "at"))
    return corners.select("cell_id", "population", "existing_clinics", "wealth_score", "kind", "shape", "corner", F.round(F.col("at")[0], 6).alias("lon"), F.round(F.col("at")[1], 6).alias("lat"))


def map_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines of each tile of all levels with their numbers."""
    found = tiles.tile_features(inputs.siting_cells(spark, sf_dir), GRID)
    return found.select("z", "x", "y", "row", "col", "cells", "population", "existing_clinics", *[_six(c) for c in ("wealth_score", "x0", "y0", "x1", "y1")])


def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' rectangles as well-known binary, in hex, and read back."""
    made = report.with_geometry(inputs.siting_cells(spark, sf_dir)).withColumn("wkb", edges_of("geometry"))
    return made.select("cell_id", "population", F.substring(F.hex("geometry"), 1, 26).alias("head"), *[_six(f"wkb.{c}", c) for c in ("x0", "y0", "x1", "y1")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "grid_cells": grid_cells,
    "poi_flatten": poi_flatten,
    "poi_exclude_tag": poi_exclude_tag,
    "poi_exclude_name": poi_exclude_name,
    "poi_union": poi_union,
    "recorded_response": recorded_response,
    "prices_csv": prices_csv,
    "cells_file": cells_file,
    "population_file": population_file,
    "geometry_file": geometry_file,
    "point_in_cell": point_in_cell,
    "cell_competitors": cell_competitors,
    "cell_context": cell_context,
    "population_overlay": population_overlay,
    "prompt_cache_key": prompt_cache_key,
    "cache_miss": cache_miss,
    "parse_response": parse_response,
    "estimate_cells": estimate_cells,
    "estimates_of_arriving_cells": estimates_of_arriving_cells,
    "estimates_left_merge": estimates_left_merge,
    "estimated_count": estimated_count,
    "normalize_minmax": normalize_minmax,
    "need_and_demand": need_and_demand,
    "candidate_filter": candidate_filter,
    "facility_type": facility_type,
    "weighted_facility_type": weighted_facility_type,
    "conflict_pairs": conflict_pairs,
    "site_selection": _selected(8),
    "site_selection_of_3": _selected(3),
    "travel_time": travel_time,
    "nearest_time": nearest_time,
    "network_time": network_time,
    "access_weighted_mean": access_weighted_mean,
    "baseline_density": baseline_density,
    "baseline_random": baseline_random,
    "before_after": before_after,
    "validation_report": _validated(8),
    "validation_report_of_3": _validated(3),
    "validation_flags": validation_flags,
    "validation_bars": validation_bars,
    "spearman": spearman,
    "spearman_vs_price": spearman_vs_price,
    "wealth_histogram": wealth_histogram,
    "score_histogram": score_histogram,
    "wealth_by_clinics": wealth_by_clinics,
    "type_counts": type_counts,
    "bounds": bounds,
    "totals": totals,
    "map_markers": map_markers,
    "map_legend": map_legend,
    "cell_outlines": cell_outlines,
    "map_tiles": map_tiles,
    "cell_geometry": cell_geometry,
}

# ------------------------------------------------------------------- oracles

_CONTEXT = SQL + """, kinds AS (
  SELECT cell_id, amenity, count(*) AS n FROM located GROUP BY ALL
), sentences AS (
  SELECT cell_id, 'Рядом медучреждений: ' || CAST(sum(n) AS BIGINT) || ' (' || coalesce(string_agg(CASE amenity WHEN 'clinic' THEN 'клиники' WHEN 'hospital' THEN 'больницы'
           WHEN 'doctors' THEN 'кабинеты врачей' WHEN 'dentist' THEN 'стоматологии' ELSE amenity END || ': ' || n, ', ' ORDER BY n DESC, amenity) FILTER (amenity IS NOT NULL), '') || ').' AS s
  FROM kinds GROUP BY cell_id
), context AS (
  SELECT cell_id, coalesce(s, 'Медучреждений рядом не обнаружено.') AS context FROM cells LEFT JOIN sentences USING (cell_id)
)"""
_PROMPT = f"'{PROMPT_HEAD}' || context || '{PROMPT_TAIL}'"
_KEYS = _CONTEXT + f""", keyed AS (
  SELECT cell_id, {_PROMPT} AS prompt, sha256('{MODEL}' || chr(10) || {_PROMPT}) AS key FROM context
)"""

_CANDIDATES = SQL + """, candidates AS (
  SELECT * FROM siting WHERE coalesce(area_character, '') <> 'industrial'
)""" + sql_scores("candidates", "c_") + """, typed AS (
  SELECT *, CASE WHEN equity >= profit THEN 'public' ELSE 'private' END AS facility_type, greatest(equity, profit) AS best_score FROM c_scored
)"""

_CHOSEN = _CANDIDATES + f""", ranked AS (
  SELECT *, row_number() OVER (ORDER BY best_score DESC, cell_id) AS k FROM typed WHERE best_score > 0
), apart AS (
  SELECT a.k AS i, b.k AS j FROM ranked a JOIN ranked b ON a.k < b.k AND {sql_haversine('a.center_lon', 'a.center_lat', 'b.center_lon', 'b.center_lat')} >= {MIN_DISTANCE_M}
), triple AS (
  SELECT p.i, p.j, q.j AS k FROM apart p JOIN apart q ON q.i = p.j JOIN apart r ON r.i = p.i AND r.j = q.j
  JOIN ranked a ON a.k = p.i JOIN ranked b ON b.k = p.j JOIN ranked c ON c.k = q.j
  ORDER BY a.best_score + b.best_score + c.best_score DESC, 1, 2, 3 LIMIT 1
), chosen AS (
  SELECT ranked.* FROM ranked, triple WHERE ranked.k IN (triple.i, triple.j, triple.k)
)"""

def _nearest(name: str, points: str) -> str:
    return f""", {name} AS (
  SELECT cell_id, min({sql_minutes('cells.center_lon', 'cells.center_lat', 'p.lon', 'p.lat')}) AS minutes FROM cells, ({points}) p GROUP BY cell_id
)"""


def _mean(times: str) -> str:
    return f"(SELECT CASE WHEN sum(population) = 0 THEN avg(minutes) ELSE sum(minutes * population) / sum(population) END FROM siting JOIN {times} USING (cell_id))"


#: The best choice of eight by growing sets in order of score; a set that can't reach the greedy total even with the best cells left is let go.
_CHOSEN_8 = _CANDIDATES + f""", ranked AS (
  SELECT *, row_number() OVER (ORDER BY best_score DESC, cell_id) AS k FROM typed WHERE best_score > 0
), far AS (
  SELECT a.k AS i, list(b.k) AS near FROM ranked a JOIN ranked b ON {sql_haversine('a.center_lon', 'a.center_lat', 'b.center_lon', 'b.center_lat')} < {MIN_DISTANCE_M} GROUP BY a.k
), summed AS (
  SELECT k, best_score, near, sum(best_score) OVER (ORDER BY k) AS upto, count(*) OVER () AS cells FROM ranked JOIN far ON far.i = k
), greedy AS (
  SELECT 0 AS n, CAST([] AS BIGINT[]) AS blocked, 0::DOUBLE AS value
  UNION ALL
  SELECT n + 1, list_concat(blocked, near), value + best_score FROM (
    SELECT g.n, g.blocked, g.value, s.near, s.best_score, row_number() OVER (ORDER BY s.k) AS o FROM greedy g JOIN summed s ON NOT list_contains(g.blocked, s.k) WHERE g.n < 8
  ) WHERE o = 1
), grown AS (
  SELECT 0 AS n, CAST([] AS BIGINT[]) AS picked, CAST([] AS BIGINT[]) AS blocked, 0::DOUBLE AS value, 0::BIGINT AS last
  UNION ALL
  SELECT g.n + 1, list_append(g.picked, s.k), list_concat(g.blocked, s.near), g.value + s.best_score, s.k
  FROM grown g JOIN summed s ON s.k > g.last AND NOT list_contains(g.blocked, s.k) JOIN summed z ON z.k = least(s.k + 7 - g.n, s.cells)
  WHERE g.n < 8 AND g.value + s.best_score + (z.upto - s.upto) >= (SELECT max(value) FROM greedy) - 1e-9
), chosen AS (
  SELECT ranked.* FROM ranked JOIN (SELECT unnest(picked) AS k FROM (SELECT picked FROM grown ORDER BY round(value, 11) DESC, picked LIMIT 1)) USING (k)
)"""

_DENSE = "SELECT center_lon AS lon, center_lat AS lat FROM (SELECT * FROM siting ORDER BY population DESC, cell_id LIMIT {})"
def _report_sql(chosen: str, n: int) -> str:
    return (
        chosen + _nearest("old_times", "SELECT lon, lat FROM fac") + _nearest("model_times", "SELECT lon, lat FROM fac UNION ALL SELECT center_lon, center_lat FROM chosen")
        + _nearest("dense_times", "SELECT lon, lat FROM fac UNION ALL " + _DENSE.format(n))
        + f""", report AS (
  SELECT 'model' AS scenario, {_mean('old_times')} AS before, {_mean('model_times')} AS after
  UNION ALL SELECT 'baseline_population_density', {_mean('old_times')}, {_mean('dense_times')}
)"""
    )


_THREE, _EIGHT = _report_sql(_CHOSEN, 3), _report_sql(_CHOSEN_8, 8)
_REPORT = "SELECT scenario, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS improvement FROM report"
_SITES = "SELECT cell_id, round(center_lon, 6) AS center_lon, round(center_lat, 6) AS center_lat, facility_type, round(best_score, 6) AS best_score, true AS optimal FROM chosen"

#: Two-sided p of a rank correlation: with r the sine of an angle, the tail of Student's t is a ratio of integrals of cos^(n - 3), by Simpson's rule.
_P_VALUE = """
WITH p AS (
  SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0
), r AS (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM p
), c AS (
  SELECT corr(a, b) AS rho, count(*) AS n FROM r
), g AS (
  SELECT i, CASE WHEN i IN (0, 200000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 200001) t(i)
), z AS (
  SELECT rho, n, asin(abs(rho)) AS low, i, w FROM c, g
), v AS (
  SELECT rho, n, (pi() / 2 - low) * sum(w * pow(cos(low + (pi() / 2 - low) * i / 200000), n - 3)) AS tail, pi() / 2 * sum(w * pow(cos(pi() / 2 * i / 200000), n - 3)) AS whole
  FROM z GROUP BY rho, n, low
)
SELECT round(rho, 6) AS rho, round(tail / whole, 6) AS p_value, n FROM v
"""

_REPLY = """
WITH d AS (
  SELECT doc_id, CAST(doc_id % 11 AS VARCHAR) AS w, ['residential', 'commercial', 'industrial', 'mixed'][doc_id % 4 + 1] AS a, (doc_id % 101)::DOUBLE / 100 AS c, doc_id % 10 AS kind FROM documents
), p AS (
  SELECT *, '{"wealth_score": ' || CASE kind WHEN 3 THEN '"' || w || '"' WHEN 4 THEN w || '.9' WHEN 5 THEN 'true' WHEN 6 THEN '"7.5"' WHEN 9 THEN CAST(doc_id % 11 + 5 AS VARCHAR) ELSE w END
         || ', "area_character": "' || CASE WHEN kind = 9 THEN ' Mixed ' ELSE a END || '"' || CASE WHEN kind = 7 THEN '' ELSE ', "confidence": ' || c END || '}' AS body
  FROM d
), r AS (
  SELECT doc_id, CASE kind WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Вот ответ:' || chr(10) || body || chr(10) || 'Конец.' WHEN 8 THEN 'не могу: ' || w ELSE body END AS raw FROM p
), j AS (
  SELECT doc_id, TRY_CAST(regexp_extract(raw, '(?s)\\{.*\\}') AS JSON) AS v FROM r
), x AS (
  SELECT doc_id,
    CASE json_type(v, '$.wealth_score') WHEN 'UBIGINT' THEN CAST(v->>'$.wealth_score' AS INTEGER) WHEN 'DOUBLE' THEN CAST(trunc(CAST(v->>'$.wealth_score' AS DOUBLE)) AS INTEGER)
      WHEN 'BOOLEAN' THEN CASE v->>'$.wealth_score' WHEN 'true' THEN 1 ELSE 0 END
      WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(v->>'$.wealth_score', '\\d+') THEN CAST(v->>'$.wealth_score' AS INTEGER) END END AS w,
    lower(trim(v->>'$.area_character')) AS a, TRY_CAST(v->>'$.confidence' AS DOUBLE) AS c
  FROM j
), y AS (
  SELECT *, coalesce(w BETWEEN 0 AND 10 AND c BETWEEN 0 AND 1 AND a IN ('residential', 'commercial', 'industrial', 'mixed'), false) AS valid FROM x
)
SELECT doc_id, CASE WHEN valid THEN w END AS wealth_score, CASE WHEN valid THEN a END AS area_character, CASE WHEN valid THEN round(c, 6) END AS confidence, valid FROM y
"""

#: Ways over the roads by rounds in which every node takes the best of itself and its neighbours.
_NETWORK = SQL + f""", nodes AS (
  SELECT osm_id AS node, lon, lat FROM raw_fac
), pairs AS (
  SELECT o_custkey AS a, 1 + (o_orderkey * 31 + o_custkey * 17) % (SELECT max(c_custkey) FROM customer) AS b FROM orders
), roads AS (
  SELECT a, b, {sql_minutes('p.lon', 'p.lat', 'q.lon', 'q.lat')} / 0.75::DOUBLE AS m FROM pairs JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b
), ways AS (
  SELECT a, b, min(m) AS m FROM (SELECT a, b, m FROM roads UNION ALL SELECT b, a, m FROM roads UNION ALL SELECT node, node, 0::DOUBLE FROM nodes) GROUP BY ALL
), rounds AS (
  SELECT 0 AS n, osm_id AS node, 0::DOUBLE AS m FROM fac WHERE amenity = 'clinic'
  UNION ALL
  SELECT r.n + 1, w.b, min(r.m + w.m) FROM rounds r JOIN ways w ON w.a = r.node WHERE r.n < 40 GROUP BY r.n + 1, w.b
), snapped AS (
  SELECT cell_id, arg_min(node, {sql_haversine('center_lon', 'center_lat', 'lon', 'lat')}) AS node, min({sql_minutes('center_lon', 'center_lat', 'lon', 'lat')}) AS way FROM cells, nodes GROUP BY cell_id
)
SELECT cell_id, round(m + way, 6) AS minutes FROM snapped LEFT JOIN (SELECT node, m FROM rounds WHERE n = 40) USING (node)"""

_PARTS = """
WITH p AS (
  SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0
), r AS (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM p
)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r
"""

ORACLES: dict[str, str] = {
    "grid_cells": SQL + "SELECT cell_id, population, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(center_lon, 6) AS center_lon, round(center_lat, 6) AS center_lat FROM siting",
    "poi_flatten": SQL + "SELECT * REPLACE (round(lon, 9) AS lon, round(lat, 9) AS lat) FROM fac",
    "recorded_response": SQL + "SELECT * REPLACE (round(lon, 9) AS lon, round(lat, 9) AS lat) FROM fac",
    "prices_csv": "SELECT printf('cell_%06d', p_partkey) AS cell_id, CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice END AS price_per_m2 FROM part",
    "cells_file": SQL + "SELECT cell_id, population, existing_clinics, round(x0, 6) AS x0, round(y1, 6) AS y1, round(x0, 6) AS wkb_x0, round(y0, 6) AS wkb_y0, round(x1, 6) AS wkb_x1, round(y1, 6) AS wkb_y1 FROM siting",
    "population_file": SQL + f"SELECT round(population, 6) AS population, round(x - {HALF_M}, 3) AS min_x, round(y + {HALF_M}, 3) AS max_y, 4 AS corners FROM squares WHERE {inputs.SQL_IN_BOX}",
    "geometry_file": SQL + f"SELECT o_orderkey, round(x - {HALF_M}, 3) AS x0, round(y - {HALF_M}, 3) AS y0, round(x + {HALF_M}, 3) AS x1, round(y + {HALF_M}, 3) AS y1 FROM squares WHERE {inputs.SQL_IN_BOX}",
    "poi_exclude_tag": SQL + "SELECT osm_id, healthcare FROM fac WHERE healthcare IS NULL OR healthcare NOT IN ('laboratory', 'rehabilitation')",
    "poi_exclude_name": SQL + "SELECT osm_id, name FROM fac WHERE NOT regexp_matches(lower(coalesce(name, '')), 'эстет|дентал')",
    "poi_union": SQL + "SELECT osm_type AS type, osm_id AS id FROM raw_fac",
    "point_in_cell": SQL + "SELECT osm_id, cell_id FROM located",
    "cell_competitors": SQL + "SELECT cell_id, existing_clinics FROM siting",
    "cell_context": _CONTEXT + "SELECT cell_id, context FROM context",
    "population_overlay": SQL + "SELECT cell_id, population FROM siting",
    "prompt_cache_key": _KEYS + "SELECT cell_id, key FROM keyed",
    "cache_miss": _KEYS + "SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE right(cell_id, 1) IN ('0', '1', '2'))",
    "parse_response": _REPLY,
    "estimate_cells": _KEYS + "SELECT cell_id, CAST(length(prompt) % 11 AS INTEGER) AS wealth_score, 'mixed' AS area_character, 0.5::DOUBLE AS confidence FROM keyed",
    "estimates_of_arriving_cells": _KEYS + "SELECT cell_id, CAST(length(prompt) % 11 AS INTEGER) AS wealth_score, 'mixed' AS area_character, 0.5::DOUBLE AS confidence FROM keyed",
    "estimates_left_merge": SQL + "SELECT cell_id, population, wealth_score, CASE WHEN wealth_score IS NOT NULL THEN area_character END AS area_character FROM siting",
    "estimated_count": SQL + "SELECT count(wealth_score) AS estimated, count(*) AS cells, CAST(sum(population) AS BIGINT) AS population FROM siting WHERE population > 0",
    "normalize_minmax": """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS v FROM part), b AS (SELECT min(v) AS lo, max(v) AS hi FROM p)
SELECT p_partkey, round((v - lo) / (hi - lo), 6) AS price_scaled, 0.0::DOUBLE AS same_scaled FROM p, b""",
    "need_and_demand": SQL + sql_scores("siting") + "SELECT cell_id, round(equity, 6) AS equity, round(profit, 6) AS profit FROM scored",
    "candidate_filter": SQL + "SELECT cell_id, area_character, population, existing_clinics FROM siting WHERE coalesce(area_character, '') <> 'industrial'",
    "facility_type": _CANDIDATES + "SELECT cell_id, facility_type, round(best_score, 6) AS best_score FROM typed",
    "weighted_facility_type": _CANDIDATES + "SELECT cell_id, CASE WHEN 0.5::DOUBLE * equity >= 2.0::DOUBLE * profit THEN 'public' ELSE 'private' END AS facility_type, round(greatest(0.5::DOUBLE * equity, 2.0::DOUBLE * profit), 6) AS best_score FROM typed",
    "conflict_pairs": SQL + f"SELECT a.cell_id AS cell_a, b.cell_id AS cell_b FROM siting a JOIN siting b ON a.cell_id < b.cell_id WHERE a.existing_clinics > 0 AND b.existing_clinics > 0 AND {sql_haversine('a.center_lon', 'a.center_lat', 'b.center_lon', 'b.center_lat')} < {MIN_DISTANCE_M}",
    "site_selection": _CHOSEN_8 + _SITES,
    "site_selection_of_3": _CHOSEN + _SITES,
    "travel_time": SQL + f"""SELECT cell_id AS src, s_suppkey AS dst,
      round({sql_minutes('center_lon', 'center_lat', '(37.55::DOUBLE + s_suppkey / 100.0::DOUBLE)', '(55.72::DOUBLE + s_suppkey / 200.0::DOUBLE)')}, 6) AS minutes FROM cells, supplier""",
    "nearest_time": SQL + _nearest("times", "SELECT lon, lat FROM fac") + "SELECT cell_id, round(minutes, 6) AS minutes FROM times",
    "network_time": _NETWORK,
    "access_weighted_mean": SQL + _nearest("times", "SELECT lon, lat FROM fac") + f"SELECT round({_mean('times')}, 6) AS minutes",
    "baseline_density": SQL + "SELECT cell_id, round(center_lon, 6) AS center_lon, round(center_lat, 6) AS center_lat FROM siting ORDER BY population DESC, cell_id LIMIT 8",
    "baseline_random": SQL + "SELECT cell_id, round(center_lon, 6) AS center_lon, round(center_lat, 6) AS center_lat FROM siting WHERE population > 0 ORDER BY md5(cell_id || '|0'), cell_id LIMIT 8",
    "before_after": SQL + _nearest("old_times", "SELECT lon, lat FROM fac") + _nearest("new_times", "SELECT lon, lat FROM fac UNION ALL " + _DENSE.format(8))
    + f"SELECT round(b, 6) AS before, round(a, 6) AS after, round(b - a, 6) AS improvement, a < b AS nearer FROM (SELECT {_mean('old_times')} AS b, {_mean('new_times')} AS a)",
    "validation_report": _EIGHT + _REPORT,
    "validation_report_of_3": _THREE + _REPORT,
    "validation_flags": _THREE + "SELECT m.after < m.before AS nearer, m.before - m.after >= b.before - b.after AS better_than_baseline FROM report m, report b WHERE m.scenario = 'model' AND b.scenario <> 'model'",
    "validation_bars": _THREE + """SELECT round(m.before, 6) AS before, round(m.after, 6) AS model_after, round(b.after, 6) AS baseline_after,
      round(m.before - m.after, 6) AS model_improvement, round(b.before - b.after, 6) AS baseline_improvement FROM report m, report b WHERE m.scenario = 'model' AND b.scenario <> 'model'""",
    "spearman": _PARTS,
    "spearman_vs_price": _P_VALUE,
    "wealth_histogram": SQL + "SELECT CAST(g AS INTEGER) AS bin, count(e.wealth_score) AS n FROM range(0, 11) t(g) LEFT JOIN (SELECT * FROM siting WHERE existing_clinics > 0) e ON least(e.wealth_score, 10) = g GROUP BY g",
    "score_histogram": SQL + sql_scores("siting") + """, s AS (
  SELECT 'equity' AS score, equity AS v FROM scored UNION ALL SELECT 'profit', profit FROM scored
), b AS (
  SELECT score, min(v) AS lo, max(v) AS hi FROM s GROUP BY score
)
SELECT b.score, CAST(g AS INTEGER) AS bin, count(s.v) AS n FROM b CROSS JOIN range(0, 20) t(g) LEFT JOIN s ON s.score = b.score AND least(19, CAST(floor((s.v - lo) / (hi - lo) * 20) AS INTEGER)) = g GROUP BY ALL""",
    "wealth_by_clinics": SQL + "SELECT least(existing_clinics, 5) AS existing_clinics, round(avg(wealth_score), 6) AS mean_wealth_score FROM siting GROUP BY 1",
    "type_counts": _CANDIDATES + "SELECT count(*) FILTER (facility_type = 'public') AS n_public, count(*) FILTER (facility_type = 'private') AS n_private FROM typed",
    "bounds": SQL + "SELECT round(min(x0), 6) AS min_lon, round(min(y0), 6) AS min_lat, round(max(x1), 6) AS max_lon, round(max(y1), 6) AS max_lat, round((min(x0) + max(x1)) / 2, 6) AS mid_lon, round((min(y0) + max(y1)) / 2, 6) AS mid_lat FROM siting WHERE existing_clinics > 0",
    "totals": SQL + "SELECT count(*) AS cells, CAST(sum(population) AS BIGINT) AS population, CAST(sum(existing_clinics) AS BIGINT) AS facilities, count(wealth_score) AS estimated FROM siting",
    "map_markers": _CHOSEN + """SELECT cell_id, round(center_lon, 6) AS lon, round(center_lat, 6) AS lat, CASE facility_type WHEN 'public' THEN '#0F6E56' ELSE '#993C1D' END AS color, round(8 + 6 * best_score, 6) AS radius,
      printf('<b>%s</b><br>Тип: %s<br>Ценность: %.2f', cell_id, CASE facility_type WHEN 'public' THEN 'государственная' ELSE 'частная' END, best_score) AS popup FROM chosen""",
    "cell_outlines": SQL + """SELECT cell_id, population, existing_clinics, wealth_score, 'Feature' AS kind, 'Polygon' AS shape, CAST(corner AS INTEGER) AS corner,
      round(CASE WHEN corner IN (1, 2) THEN x1 ELSE x0 END, 6) AS lon, round(CASE WHEN corner IN (2, 3) THEN y1 ELSE y0 END, 6) AS lat FROM siting, range(0, 5) t(corner)""",
    "map_tiles": SQL + """, pyramid AS (
  SELECT z, CAST(r // (1 << ({1} - z)) AS INTEGER) AS row, CAST(c // (1 << ({1} - z)) AS INTEGER) AS col, count(*) AS cells, CAST(sum(population) AS BIGINT) AS population,
         CAST(sum(existing_clinics) AS BIGINT) AS existing_clinics, avg(wealth_score) AS wealth_score, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM siting, (SELECT CAST(g AS INTEGER) AS z FROM range({0}, {1} + 1) t(g)) GROUP BY ALL
)
SELECT z, CAST(floor(((x0 + x1) / 2 / 360 + 0.5::DOUBLE) * (1 << z)) AS INTEGER) AS x, CAST(floor((0.5::DOUBLE - ln(tan(pi() / 4 + radians((y0 + y1) / 2) / 2)) / (2 * pi())) * (1 << z)) AS INTEGER) AS y,
  row, col, cells, population, existing_clinics, round(wealth_score, 6) AS wealth_score, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM pyramid""".format(*tiles.levels(GRID)),
    "cell_geometry": SQL + "SELECT cell_id, population, '01030000000100000005000000' AS head, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM siting",
    "map_legend": _CANDIDATES + """SELECT k.facility_type, k.label, k.color, count(typed.cell_id) AS n FROM (VALUES ('public', 'государственная', '#0F6E56'), ('private', 'частная', '#993C1D')) k(facility_type, label, color)
      LEFT JOIN typed USING (facility_type) GROUP BY ALL""",
}
