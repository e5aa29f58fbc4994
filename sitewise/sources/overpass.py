"""Points of interest of an Overpass service, live or from recorded responses."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sitewise import schemas
from sitewise.durable import durable
from sitewise.operators.pois import distinct_elements, exclude_name, exclude_tag, flatten


# The service's language.
QUERY, CLAUSE = "[out:json][timeout:60];({});out center;", '{}["{}"="{}"]({},{},{},{});'

#: Degrees of a side below which a box isn't halved any more.
SMALLEST = 1e-4


def build_query(bbox: Sequence[float], tags: Sequence[str]) -> str:
    """Nodes and ways of every ``key=value`` tag within min_lon, min_lat, max_lon, max_lat, with the ways' centres."""
    west, south, east, north = bbox
    clauses = []
    for tag in tags:
        key, value = tag.split("=")
        clauses += [CLAUSE.format(kind, key, value, south, west, north, east) for kind in ("node", "way")]
    return QUERY.format("".join(clauses))


class TooLarge(Exception):
    """The service can't answer for so large a box."""


def ask(url: str, query: str, *, timeout_s: float = 90) -> dict:
    """A response; TooLarge if the service refuses the size or gives up, or no answer comes in time."""
    body = urllib.parse.urlencode({"data": query}).encode()
    request = urllib.request.Request(url, body, {"User-Agent": "sitewise/0.1"})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as got:
            response = json.load(got)
    except urllib.error.HTTPError as e:
        if e.code in (413, 504):
            raise TooLarge(str(e)) from e
        raise
    except TimeoutError as e:
        raise TooLarge("no answer in time") from e
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TooLarge("no answer in time") from e
        raise
    if "runtime error" in response.get("remark", ""):
        raise TooLarge(response["remark"])
    return response


def ask_again(fetch: Callable[[str], dict], query: str, *, retries: int, pause_s: float) -> dict:
    """A response after at most so many attempts; a refused size isn't tried again."""
    last: Exception | None = None
    for _ in range(retries):
        try:
            return fetch(query)
        except TooLarge:
            raise
        except Exception as e:
            last = e
            time.sleep(pause_s)
    raise RuntimeError(f"no answer after {retries} attempts: {last}") from last


def elements_of(response: dict) -> Iterator[tuple]:
    for e in response.get("elements", []):
        centre = e.get("center")
        yield e["type"], e["id"], e.get("lat"), e.get("lon"), (centre["lat"], centre["lon"]) if centre else None, e.get("tags", {})


class _Tag(InputPartition):
    def __init__(self, tag: str) -> None:
        self.tag = tag


class OverpassReader(DataSourceReader):
    """A task for each tag; it tries again after failures."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.bbox = [float(x) for x in options["bbox"].split(",")]
        self.tags = options["tags"].split(",")
        self.retries = int(options.get("retries", "4"))
        self.pause_s = float(options.get("pause_s", "8"))

    def partitions(self) -> list[InputPartition]:
        return [_Tag(t) for t in self.tags]

    def _fetch(self, query: str) -> dict:
        return ask(self.url, query)

    def read(self, partition: _Tag) -> Iterator[tuple]:
        yield from elements_of(ask_again(self._fetch, build_query(self.bbox, [partition.tag]), retries=self.retries, pause_s=self.pause_s))


class OverpassDataSource(DataSource):
    """Format ``overpass``: options url, bbox and tags (comma-separated), retries, pause_s."""

    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> StructType:
        return schemas.ELEMENT

    def reader(self, schema: StructType) -> OverpassReader:
        return OverpassReader(dict(self.options))


def recorded_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of recorded responses; a response without any gives none."""
    return spark.read.schema(schemas.RESPONSE).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def halves(west: float, south: float, east: float, north: float) -> list[tuple[float, float, float, float]]:
    """A box in two along its longer side on the ground."""
    if (east - west) * math.cos(math.radians((south + north) / 2)) > north - south:
        middle = (west + east) / 2
        return [(west, south, middle, north), (middle, south, east, north)]
    middle = (south + north) / 2
    return [(west, south, east, middle), (west, middle, east, north)]


def _visiting(url: str, retries: int, pause_s: float, timeout_s: float):
    """Elements of (tag, box); for a refused box a row without a type for each half, with its tag."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["type", "id", "lat", "lon", "center", "tags", "tag", "west", "south", "east", "north"]
        for frame in frames:
            for r in frame.itertuples():
                box = (r.west, r.south, r.east, r.north)
                try:
                    response = ask_again(partial(ask, url, timeout_s=timeout_s), build_query(box, [r.tag]), retries=retries, pause_s=pause_s)
                    rows = [(*e[:4], e[4] and {"lat": e[4][0], "lon": e[4][1]}, e[5], None, None, None, None, None) for e in elements_of(response)]
                except TooLarge as e:
                    if max(r.east - r.west, r.north - r.south) < SMALLEST:
                        raise RuntimeError(f"{r.tag} is refused even for {box}: {e}") from e
                    rows = [(None, None, None, None, None, None, r.tag, *half) for half in halves(*box)]
                yield pd.DataFrame(rows, columns=columns, dtype=object).astype({c: "float64" for c in ("lat", "lon", "west", "south", "east", "north")} | {"id": "Int64"})

    return visit


def fetch_elements(spark: SparkSession, bbox: Sequence[float], tags: Sequence[str], url: str, *, retries: int = 4, pause_s: float = 8.0, timeout_s: float = 90.0) -> DataFrame:
    """Elements of a live service, each once: a task for each tag and tile.

    All begin with the whole box. Where the service refuses its size or runs out of time, the tile's halves are dealt out as tasks of the next
    round. An element on a border, or of several tags, comes from more than one of them.
    """
    kind = T.StructType([*schemas.ELEMENT.fields, T.StructField("tag", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("west", "south", "east", "north")]])
    tiles = spark.createDataFrame([(t, *map(float, bbox)) for t in tags], "tag string, west double, south double, east double, north double")
    found, left = spark.createDataFrame([], schemas.ELEMENT), len(tags)
    while left:
        done = durable(tiles.repartition(left).mapInPandas(_visiting(url, retries, pause_s, timeout_s), kind))
        found = found.unionByName(done.where("type is not null").select(*schemas.ELEMENT.names))
        tiles = done.where("type is null").select("tag", "west", "south", "east", "north")
        left = tiles.count()
    return distinct_elements(found)


def fetch_pois(
    spark: SparkSession, bbox: Sequence[float], tags: Sequence[str], url: str, *, exclude_healthcare: Sequence[str] | None = None,
    exclude_name_keywords: Sequence[str] | None = None, retries: int = 4, pause_s: float = 8.0,
) -> DataFrame:
    """The facility table of a live service, without the excluded kinds and names."""
    elements = fetch_elements(spark, bbox, tags, url, retries=retries, pause_s=pause_s)
    return exclude_name(exclude_tag(flatten(elements), exclude_healthcare), exclude_name_keywords)
