"""The stages of a siting run: collect, estimate, optimise, validate, report. Each hands a table on; files are the caller's choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.config import Config
from sitewise.durable import durable
from sitewise.operators import report as pages
from sitewise.operators.access import validation_report
from sitewise.operators.estimates import Model, chat_model, estimate_cells, with_estimates
from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.scores import filter_candidates, with_facility_type, with_scores
from sitewise.operators.selection import select_sites
from sitewise.operators.spatial import contexts, count_facilities, population_per_cell
from sitewise.operators.tiles import write_tiles
from sitewise.sources.geopackage import load_population
from sitewise.sources.overpass import fetch_pois


def grid_of(config: Config) -> Grid:
    return Grid(tuple(config.area.bbox), config.grid.cell_size_m, config.grid.id_prefix)


def collect(spark: SparkSession, grid: Grid, facilities: DataFrame, hexagons: DataFrame) -> DataFrame:
    """The grid's cells with population, existing_clinics and context."""
    counted = population_per_cell(count_facilities(build_grid(spark, grid), facilities, grid), hexagons, grid)
    return counted.join(contexts(counted, facilities, grid), "cell_id")


def estimate(config: Config, cells: DataFrame, make_model: Callable[[], Model] | None = None, *, limit: int | None = None) -> DataFrame:
    """The cells with the model's estimates; limit: only the first cells by id are asked about."""
    e = config.estimate
    asked = cells.select("cell_id", "context")
    if limit is not None:
        asked = asked.orderBy("cell_id").limit(limit)
    maker = make_model or chat_model(e.base_url, e.model, api_key_env=e.api_key_env, temperature=e.temperature)
    found = estimate_cells(asked, maker, model_name=e.model, cache_path=e.cache_dir, max_retries=e.max_retries, pause_s=e.request_pause_s, tasks=e.tasks, concurrency=e.concurrency, per_second=e.requests_per_s or None)
    return with_estimates(cells, found)


def optimise(cells: DataFrame, grid: Grid, *, budget: int, min_distance_m: float, equity_weight: float = 1.0, profit_weight: float = 1.0) -> DataFrame:
    """The recommended cells; scores are scaled over the candidates only."""
    scored = with_facility_type(with_scores(filter_candidates(cells)), equity_weight=equity_weight, profit_weight=profit_weight)
    return select_sites(scored, grid, budget=budget, min_distance_m=min_distance_m)


def run_all(spark: SparkSession, config: Config, make_model: Callable[[], Model] | None = None) -> DataFrame:
    """All stages over live sources; writes the tables, the map and its outlines, and returns the validation report."""
    grid, source, out = grid_of(config), config.data.osm, config.output
    facilities = durable(
        fetch_pois(
            spark, grid.bbox, source.clinic_tags, source.overpass_url, exclude_healthcare=source.exclude_healthcare,
            exclude_name_keywords=source.exclude_name_keywords, retries=source.retries, pause_s=source.retry_pause_s,
        )
    )
    cells = durable(collect(spark, grid, facilities, load_population(spark, config.data.population.file, grid.bbox)))
    pages.save_cells(cells, f"{out.processed_dir}/cells.parquet")
    estimated = durable(estimate(config, cells, make_model))
    pages.save_cells(estimated, f"{out.processed_dir}/cells_estimated.parquet")
    pages.write_csv(estimated, f"{out.processed_dir}/cells_estimated.csv", files=None)
    o = config.optimize
    chosen = durable(optimise(estimated, grid, budget=o.budget_clinics, min_distance_m=o.min_distance_m, equity_weight=o.weights.equity, profit_weight=o.weights.profit))
    pages.write_csv(chosen, f"{out.tables_dir}/recommendations.csv")
    report = durable(validation_report(estimated, facilities.select("lon", "lat"), chosen, grid, baseline=config.validate.baseline))
    pages.write_csv(report, f"{out.tables_dir}/validation.csv")
    pages.write_geojson(estimated, f"{out.maps_dir}/cells.geojson")
    write_tiles(estimated, grid, f"{out.maps_dir}/tiles")
    pages.tiled_page(chosen, grid, tiles="../tiles", base=out.base_map).write.mode("overwrite").text(f"{out.maps_dir}/recommendations")
    return report.orderBy(F.desc("scenario"))
