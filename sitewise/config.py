"""Settings of a siting run: a YAML file read into frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Area:
    #: min_lon, min_lat, max_lon, max_lat in degrees.
    bbox: tuple[float, float, float, float] = (37.55, 55.72, 37.65, 55.78)


@dataclass(frozen=True)
class GridSettings:
    cell_size_m: float = 500
    id_prefix: str = "cell_"


@dataclass(frozen=True)
class PoiSource:
    overpass_url: str = ""
    clinic_tags: tuple[str, ...] = ()
    exclude_healthcare: tuple[str, ...] = ()
    exclude_name_keywords: tuple[str, ...] = ()
    retries: int = 4
    retry_pause_s: float = 8.0


@dataclass(frozen=True)
class PopulationSource:
    file: str = ""


@dataclass(frozen=True)
class Data:
    osm: PoiSource = field(default_factory=PoiSource)
    population: PopulationSource = field(default_factory=PopulationSource)


@dataclass(frozen=True)
class Estimate:
    model: str = ""
    base_url: str = ""
    api_key_env: str = "SITEWISE_API_KEY"
    temperature: float = 0
    max_retries: int = 2
    request_pause_s: float = 0.5
    #: Tasks that call the model, calls that each runs at once, and calls of all in a second (0: no limit).
    tasks: int = 8
    concurrency: int = 1
    requests_per_s: float = 0
    cache_dir: str = ""


@dataclass(frozen=True)
class Weights:
    equity: float = 1.0
    profit: float = 1.0


@dataclass(frozen=True)
class Optimize:
    budget_clinics: int = 8
    min_distance_m: float = 1000
    weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Validate:
    baseline: str = "population_density"


@dataclass(frozen=True)
class Output:
    processed_dir: str = "data/processed"
    tables_dir: str = "outputs/tables"
    maps_dir: str = "outputs/maps"
    #: Address of the map's background tiles with {z}, {x} and {y}; none if empty.
    base_map: str = ""
    figures_dir: str = "outputs/figures"


@dataclass(frozen=True)
class Config:
    area: Area = field(default_factory=Area)
    grid: GridSettings = field(default_factory=GridSettings)
    data: Data = field(default_factory=Data)
    estimate: Estimate = field(default_factory=Estimate)
    optimize: Optimize = field(default_factory=Optimize)
    validate: Validate = field(default_factory=Validate)
    output: Output = field(default_factory=Output)


def _build(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from a mapping; keys that it doesn't know are left out."""
    made = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        value, default = values[f.name], f.default_factory() if callable(f.default_factory) else f.default
        if is_dataclass(default):
            value = _build(type(default), value or {})
        elif isinstance(default, tuple):
            value = tuple(value or ())
        made[f.name] = value
    return kind(**made)


def load_config(path: str = "config.yaml") -> Config:
    """The settings of a YAML file; a missing file is named by its whole path."""
    import yaml

    at = Path(path)
    if not at.is_file():
        raise FileNotFoundError(f"no settings at {at.resolve()}")
    return _build(Config, yaml.safe_load(at.read_text("utf-8")) or {})
