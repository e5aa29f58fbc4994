"""Population polygons in GeoPackage files, read by tasks over files or ranges of row ids with filters pushed to the spatial index, and written by tasks."""

from __future__ import annotations

import contextlib
import math
import operator
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from sitewise import schemas
from sitewise.functions.geo import MERCATOR_M
from sitewise.sources.staged import StagedFiles, Written, located, visible

#: Rows of a task that reads, and of a file that one writes.
RANGE = 100_000
#: Fixed value: the number of the projection in files.
SRS = 3857
#: Bytes of the envelope after a geometry's header, by its code.
_ENVELOPES = (0, 32, 48, 48, 64)


Ring = list[tuple[float, float]]


def polygons(blob: bytes) -> list[list[Ring]]:
    """The polygons of a GeoPackage polygon or of several, each as its rings without the closing corner, the outer one first."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    if blob[3] & 0x10:
        return []
    at = 8 + _ENVELOPES[blob[3] >> 1 & 7]

    def header() -> tuple[str, int]:
        """Byte order and kind at the place, which moves on."""
        nonlocal at
        order = "<" if blob[at] else ">"
        kind = struct.unpack_from(order + "I", blob, at + 1)[0]
        at += 5
        return order, kind

    def count(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", blob, at - 4)[0]

    def polygon(order: str, kind: int) -> list[Ring]:
        nonlocal at
        if kind % 1000 != 3:
            raise ValueError(f"a polygon is needed, not kind {kind}")
        dimensions = 2 + {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        rings = []
        for _ in range(count(order)):
            n = count(order)
            flat = struct.unpack_from(f"{order}{n * dimensions}d", blob, at)
            at += 8 * n * dimensions
            ring = list(zip(flat[::dimensions], flat[1::dimensions], strict=True))
            rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        return rings

    order, kind = header()
    parts = [polygon(*header()) for _ in range(count(order))] if kind % 1000 == 6 else [polygon(order, kind)]
    # Without an outer ring there is no area, and a ring without corners bounds none.
    return [[r for r in rings if r] for rings in parts if rings and rings[0]]


def _doubled_area(ring: Ring) -> float:
    (x, y), after = ring[0], [*ring[1:], ring[0]]
    return sum((p[0] - x) * (q[1] - y) - (q[0] - x) * (p[1] - y) for p, q in zip(ring, after, strict=True))


def outer_ring(blob: bytes) -> Ring:
    """One closed way around all parts of a geometry and the other way around their holes; an empty one has no corners.

    A geometry of one ring is that ring. The rings of others hang on the first
    corner by ways that are gone there and back: these bound no area, nor do their
    pieces in a rectangle, so signed areas of the way and of its cuts are the geometry's.
    """
    parts = polygons(blob)
    rings = [(r, k > 0) for part in parts for k, r in enumerate(part)]
    if len(rings) < 2:
        return rings[0][0] if rings else []
    way: Ring = []
    for ring, hole in rings:
        turned = ring if (_doubled_area(ring) < 0) == hole else ring[::-1]
        way += [*turned, turned[0]]
        if len(way) > len(turned) + 1:
            way.append(way[0])
    return way


class _Rows(InputPartition):
    """A file, and the row ids of one task; None: all."""

    def __init__(self, path: str, low: int | None = None, high: int | None = None) -> None:
        self.path, self.low, self.high = path, low, high


def _open(path: str) -> sqlite3.Connection:
    """A file of a mounted file system is read in place, another one is loaded."""
    fs, at = located(path)
    if isinstance(fs, arrow_fs.LocalFileSystem):
        return sqlite3.connect(f"file:{at}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    with fs.open_input_stream(at) as f:
        db.deserialize(f.read())
    return db


_COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}
#: Where the spatial index, whose boxes are rounded outwards, may decide: column, comparison, its column and sign.
_INDEXED = {("max_x", ">"): ("maxx", ">="), ("max_y", ">"): ("maxy", ">="), ("min_x", "<"): ("minx", "<="), ("min_y", "<"): ("miny", "<=")}


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.table, self.columns = options["path"], options.get("table"), columns
        self.conditions: list[tuple[str, type[Filter], float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the people and the box with constants are this reader's."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("population", "min_x", "max_x", "min_y", "max_y") and (type(f) in _COMPARED or isinstance(f, IsNotNull)):
                self.conditions.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _names(self, db: sqlite3.Connection) -> tuple[str, str, str]:
        """Table, its geometry column and its row id column."""
        found = db.execute("select table_name, column_name from gpkg_geometry_columns where ? is null or table_name = ? limit 1", (self.table, self.table)).fetchone()
        if not found:
            raise ValueError("the file has no such table of geometries")
        key = next((r[1] for r in db.execute(f'pragma table_info("{found[0]}")') if r[5]), "rowid")
        return found[0], found[1], key

    def partitions(self) -> list[InputPartition]:
        """A task for each file of a folder, or for each range of ids of a single file."""
        files = visible(self.path, ".gpkg")
        if len(files) != 1:
            return [_Rows(f) for f in files]
        with contextlib.closing(_open(files[0])) as db:
            table, _, key = self._names(db)
            low, high = db.execute(f'select min("{key}"), max("{key}") from "{table}"').fetchone()
        return [] if low is None else [_Rows(files[0], a, min(high, a + RANGE - 1)) for a in range(low, high + 1, RANGE)]

    def _where(self, db: sqlite3.Connection, partition: _Rows, table: str, shape: str, key: str) -> tuple[str, list[float]]:
        parts, values = [f't."{shape}" is not null'], []
        if partition.low is not None:
            parts.append(f't."{key}" between ? and ?')
            values += [partition.low, partition.high]
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">", LessThan: "<", LessThanOrEqual: "<"}
        boxes = [(*_INDEXED[c, signs[k]], v) for c, k, v in self.conditions if k in signs and (c, signs[k]) in _INDEXED]
        index = f"rtree_{table}_{shape}"
        if boxes and db.execute("select 1 from sqlite_master where name = ?", (index,)).fetchone():
            parts.append(f't."{key}" in (select id from "{index}" where {" and ".join(f"{c} {sign} ?" for c, sign, _ in boxes)})')
            values += [v for *_, v in boxes]
        return " and ".join(parts), values

    def read(self, partition: _Rows) -> Iterator[tuple]:
        shaped = bool({*self.columns, *(c for c, *_ in self.conditions)} - {"population"})
        with contextlib.closing(_open(partition.path)) as db:
            table, shape, key = self._names(db)
            where, values = self._where(db, partition, table, shape, key)
            # Without the ring or its box only the header is read, which says whether the geometry is empty.
            blob_column = f't."{shape}"' if shaped else f'substr(t."{shape}", 1, 4)'
            for population, blob in db.execute(f'select t.population, {blob_column} from "{table}" t where {where}', values):
                row: dict[str, object] = {"population": None if population is None else float(population)}
                if shaped:
                    if not (ring := outer_ring(blob)):
                        continue
                    xs, ys = [x for x, _ in ring], [y for _, y in ring]
                    row |= {"ring": ring, "min_x": min(xs), "max_x": max(xs), "min_y": min(ys), "max_y": max(ys)}
                elif blob[3] & 0x10:
                    continue
                if all(row[c] is not None and (k is IsNotNull or _COMPARED[k](row[c], v)) for c, k, v in self.conditions):
                    yield tuple(row[c] for c in self.columns)


def _blob(ring: Ring) -> bytes:
    """A ring as a geometry with its box."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    closed = [*ring, ring[0]]
    head = b"GP\x00\x03" + struct.pack("<i4d", SRS, min(xs), max(xs), min(ys), max(ys))
    return head + struct.pack(f"<BIII{2 * len(closed)}d", 1, 3, 1, len(closed), *[v for p in closed for v in p])


def _package(rows: list[tuple[float | None, Ring]]) -> bytes:
    """A file of one table ``areas`` with a spatial index."""
    with contextlib.closing(sqlite3.connect(":memory:")) as db:
        db.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text)")
        db.execute("insert into gpkg_spatial_ref_sys values ('spherical Mercator', ?, 'EPSG', ?, 'undefined')", (SRS, SRS))
        db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
        db.execute("insert into gpkg_contents values ('areas', 'features', 'areas', ?)", (SRS,))
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
        db.execute("insert into gpkg_geometry_columns values ('areas', 'geom', 'POLYGON', ?, 0, 0)", (SRS,))
        db.execute("create table areas (fid integer primary key, population real, geom blob)")
        db.execute("create virtual table rtree_areas_geom using rtree(id, minx, maxx, miny, maxy)")
        db.executemany("insert into areas values (?, ?, ?)", ((i, p, _blob(r)) for i, (p, r) in enumerate(rows)))
        boxes = ((i, min(x for x, _ in r), max(x for x, _ in r), min(y for _, y in r), max(y for _, y in r)) for i, (_, r) in enumerate(rows))
        db.executemany("insert into rtree_areas_geom values (?, ?, ?, ?, ?)", boxes)
        db.commit()
        return db.serialize()


class GeoPackageWriter(DataSourceArrowWriter):
    """A file for each ``RANGE`` rows of a task, built in memory; rows without a ring have no geometry to write and are left out."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.files = StagedFiles(options["path"], ".gpkg", overwrite)
        self.places = [schema.names.index(c) for c in ("population", "ring")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, rows, held = [], 0, []

        def flush() -> None:
            nonlocal rows
            name, out = self.files.create()
            with out:
                out.write(_package(held))
            names.append(name)
            rows += len(held)
            held.clear()

        for batch in iterator:
            for population, ring in zip(*(batch.column(k).to_pylist() for k in self.places), strict=True):
                if ring:
                    held.append((population, [(p["x"], p["y"]) for p in ring]))
                if len(held) == RANGE:
                    flush()
        if held:
            flush()
        return Written(names, rows)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.abort()


class GeoPackageDataSource(DataSource):
    """Format ``gpkg``: options path (a file, or a folder of files, that every executor sees) and table.

    Filters on population and on the box's columns reach the file and its spatial index; a schema of fewer columns reads
    no more than those. Writing puts (population, ring) of each task into files of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> StructType | str:
        return schemas.BOXED_HEXAGONS

    def reader(self, schema: StructType) -> GeoPackageReader:
        return GeoPackageReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> GeoPackageWriter:
        return GeoPackageWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets sources in Python see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoPackageDataSource)


def load_population(spark: SparkSession, path: str, bbox: Sequence[float] | None = None) -> DataFrame:
    """population, ring (projected metres) of a file or folder; bbox in degrees keeps the polygons whose box meets it."""
    register(spark)
    areas = spark.read.format("gpkg").option("path", path).load()
    if bbox is not None:
        x = [MERCATOR_M * math.radians(v) for v in (bbox[0], bbox[2])]
        y = [MERCATOR_M * math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (bbox[1], bbox[3])]
        areas = areas.where((F.col("max_x") >= x[0]) & (F.col("min_x") <= x[1]) & (F.col("max_y") >= y[0]) & (F.col("min_y") <= y[1]))
    return areas.select("population", "ring")


def write_population(polygons: DataFrame, path: str) -> None:
    """population, ring in GeoPackage files, a few a task, in place of what the folder had."""
    register(polygons.sparkSession)
    polygons.select("population", "ring").write.format("gpkg").mode("overwrite").option("path", path).save()
