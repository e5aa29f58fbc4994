"""GeoPackage and geometry files: filters, columns, commits, and layout."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from sitewise.operators.report import with_geometry
from sitewise.plans import inputs
from sitewise.sources.geofile import GeoFileWriter, edges_of, in_box, on_curve, read_geometries, write_geometries
from sitewise.sources.geopackage import load_population, register, write_population
from sitewise.sources.staged import StagedFiles, Written, visible
from test_sources_and_plan import package  # noqa: F401

SF = "/root/testdata/sf0.001"
RINGS = "population double, ring array<struct<x: double, y: double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def square(x, y, size=10.0):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_packages_written_by_tasks_are_read_back(spark, tmp_path):
    rows = [(float(i) if i % 7 else None, square(30.0 * i, -5.0 * i)) for i in range(300)] + [(1.0, None), (2.0, [])]
    table = spark.createDataFrame(rows, RINGS).repartition(5)
    write_population(table, str(tmp_path))
    write_population(table, str(tmp_path))  # in place of the first
    assert len(list(tmp_path.glob("*.gpkg"))) == 5 and not list(tmp_path.glob("_*"))
    got = {(r["population"], tuple(map(tuple, r["ring"]))) for r in load_population(spark, str(tmp_path)).collect()}
    assert got == {(p, tuple(r)) for p, r in rows if r}
    assert load_population(spark, str(tmp_path)).count() == 300


def test_filters_reach_the_package(spark, tmp_path):
    rows = [(float(i), square(30.0 * i, -5.0 * i)) for i in range(300)] + [(None, square(100.0, 0.0))]
    write_population(spark.createDataFrame(rows, RINGS).repartition(3), str(tmp_path))
    areas = spark.read.format("gpkg").option("path", str(tmp_path)).load()
    cases = [
        ("max_x >= 600 and min_x <= 900 and max_y >= -120 and min_y <= 0", lambda p, x, y: x + 10 >= 600 and x <= 900 and y + 10 >= -120 and y <= 0),
        ("max_x > 610 and min_x < 900", lambda p, x, y: x + 10 > 610 and x < 900), ("min_x >= 600", lambda p, x, y: x >= 600), ("max_y <= -40.0", lambda p, x, y: y + 10 <= -40),
        ("population > 250", lambda p, x, y: p is not None and p > 250), ("min_x = 60", lambda p, x, y: x == 60), ("population is not null", lambda p, x, y: p is not None),
    ]
    for condition, keep in cases:
        found = areas.where(condition)
        assert ") Filter " not in plan(found), condition
        want = sorted(str(p) for p, ring in rows if keep(p, *ring[0]))
        assert sorted(str(r["population"]) for r in found.collect()) == want, condition
    # What isn't the reader's stays in the plan.
    mixed = areas.where("min_x >= 600 and size(ring) = 4 and population % 2 = 0")
    assert ") Filter " in plan(mixed) and mixed.count() == 140


def test_a_schema_of_fewer_columns_reads_no_geometry(spark, package):  # noqa: F811
    register(spark)
    reader = spark.read.format("gpkg").option("path", package)
    people = reader.schema("population double").load()
    assert people.columns == ["population"] and sorted(r[0] for r in people.collect()) == [float(i) for i in range(20)]
    boxes = reader.schema("max_x double, population double").load().where("max_x > 4181000")
    assert {(r["population"], r["max_x"]) for r in boxes.collect()} == {(float(i), 4_180_200.0 + 300 * i) for i in range(20) if 4_180_200 + 300 * i > 4_181_000}


def test_only_named_files_of_a_write_show(tmp_path):
    path = str(tmp_path / "t")
    first = StagedFiles(path, ".x", False)
    for content in (b"lost", b"kept"):
        name, out = first.create()
        with out:
            out.write(content)
    assert first.commit([Written([name], 1), None]) == [name]
    assert [open(f, "rb").read() for f in visible(path, ".x")] == [b"kept"] and not list((tmp_path / "t").glob("_*"))
    second = StagedFiles(path, ".x", True)
    second.create()[1].close()
    second.abort()
    assert len(visible(path, ".x")) == 1 and os.listdir(path) == [name]
    third = StagedFiles(path, ".x", True)
    name, out = third.create()
    out.close()
    third.commit([Written([name], 0)])
    assert os.listdir(path) == [name]
    with pytest.raises(FileNotFoundError):
        visible(f"{path}/none", ".x")


def test_places_on_the_curve(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 3), (65535, 65535), (40000, 123)]
    want = [sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16)) for x, y in pairs]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x int, y int").select("i", on_curve(F.col("x"), F.col("y")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == want


def test_a_box_skips_row_groups(spark, tmp_path):
    squares = with_geometry(inputs.squares(spark, "/root/testdata/sf0.01"))
    write_geometries(squares, str(tmp_path), rows_per_group=100, geographic=False)
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("*.parquet")]
    assert sum(m.num_row_groups for m in groups) >= 150 and all(m.row_group(g).num_rows <= 100 for m in groups for g in range(m.num_row_groups))
    assert json.loads(groups[0].metadata[b"geo"])["columns"]["geometry"]["encoding"] == "WKB"
    west, south, east, north = inputs.METRIC_BOX
    found = in_box(read_geometries(spark, str(tmp_path)), *inputs.METRIC_BOX)
    assert "GreaterThanOrEqual(x1" in plan(found)
    want = {r["o_orderkey"] for r in squares.where((F.col("x1") >= west) & (F.col("x0") <= east) & (F.col("y1") >= south) & (F.col("y0") <= north)).collect()}
    assert {r["o_orderkey"] for r in found.collect()} == want and want

    def met(m, g):
        s = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c).statistics for c in range(m.num_columns)}
        return s["x1"].max >= west and s["x0"].min <= east and s["y1"].max >= south and s["y0"].min <= north

    read = [met(m, g) for m in groups for g in range(m.num_row_groups)]
    assert 0 < sum(read) < len(read) / 5
    edges = found.select("x0", "y0", "x1", "y1", edges_of("geometry").alias("e")).collect()
    assert all(tuple(r["e"]) == (r["x0"], r["y0"], r["x1"], r["y1"]) for r in edges)


def test_odd_geometry_rows(spark, tmp_path):
    kind = "x0 double, y0 double, x1 double, y1 double, geometry binary, name string"
    rows = [(None, None, None, None, None, "none"), (1.0, 1.0, 1.0, 1.0, b"\x01", "point"), (1.0, 1.0, 1.0, 1.0, None, None)]
    for given in (rows, rows[:1], []):
        write_geometries(spark.createDataFrame(given, kind), str(tmp_path))
        assert sorted(map(repr, spark.read.schema(kind).parquet(str(tmp_path)).collect())) == sorted(repr(r) for r in spark.createDataFrame(given, kind).collect())


def test_a_writer_cuts_its_batches_into_row_groups(tmp_path, spark):
    kind = spark.createDataFrame([], "x0 double, geometry binary").schema
    writer = GeoFileWriter({"path": str(tmp_path), "rows_per_group": "7"}, kind, False)
    batches = [pa.RecordBatch.from_pydict({"x0": [float(i) for i in range(n)], "geometry": [b""] * n}) for n in (5, 20, 0, 1)]
    done = writer.write(iter(batches))
    writer.commit([done, writer.write(iter([]))])
    m = pq.ParquetFile(str(tmp_path / done.names[0])).metadata
    assert done.rows == 26 and [m.row_group(g).num_rows for g in range(m.num_row_groups)] == [7, 7, 7, 5]
