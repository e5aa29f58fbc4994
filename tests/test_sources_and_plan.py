import math
import sqlite3
import struct

import pytest

from sitewise.config import load_config
from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.report import write_csv
from sitewise.operators.overlay import overlay
from sitewise.plans.siting import collect, estimate, grid_of, optimise
from sitewise.sources.geopackage import load_population, outer_ring


def blob(ring, order="<", envelope=True, several=False):
    head = b"GP\x00" + bytes([(1 << 1 if envelope else 0) | 1]) + struct.pack("<i", 3857) + (struct.pack("<4d", 0, 0, 0, 0) if envelope else b"")
    mark = b"\x01" if order == "<" else b"\x00"
    polygon = mark + struct.pack(f"{order}III", 3, 1, len(ring)) + struct.pack(f"{order}{2 * len(ring)}d", *[v for p in ring for v in p])
    return head + (mark + struct.pack(f"{order}II", 6, 1) + polygon if several else polygon)


@pytest.fixture
def package(tmp_path):
    path = tmp_path / "people.gpkg"
    db = sqlite3.connect(path)
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('hexes', 'geom')")
    db.execute("create table hexes (fid integer primary key, population real, geom blob)")
    db.execute("create virtual table rtree_hexes_geom using rtree(id, minx, maxx, miny, maxy)")
    for i in range(20):
        x, y = 4_180_000 + 300 * i, 7_508_000 + 300 * i
        ring = [(x, y), (x + 200, y), (x + 200, y + 200), (x, y + 200), (x, y)]
        db.execute("insert into hexes values (?, ?, ?)", (i + 1, float(i), blob(ring, "<" if i % 2 else ">", i % 3 == 0, i % 4 == 0)))
        db.execute("insert into rtree_hexes_geom values (?, ?, ?, ?, ?)", (i + 1, x, x + 200, y, y + 200))
    db.execute("insert into hexes values (99, 5.0, null)")
    db.commit()
    db.close()
    return str(path)


def test_geopackage(spark, package):
    rows = load_population(spark, package).collect()
    assert sorted(r["population"] for r in rows) == [float(i) for i in range(20)] and all(len(r["ring"]) == 4 for r in rows)
    some = load_population(spark, package, (37.55, 55.74, 37.565, 55.752)).collect()
    assert 0 < len(some) < 20


def polygons_blob(polygons, order="<", kind=3):
    """Several polygons, each a list of rings; kind 1003 has heights."""
    mark = b"\x01" if order == "<" else b"\x00"
    height = (7.0,) if kind == 1003 else ()
    whole = b"".join(
        mark + struct.pack(f"{order}II", kind, len(rings))
        + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + len(height)}d", *p, *height) for p in r) for r in rings)
        for rings in polygons
    )
    return b"GP\x00\x01" + struct.pack("<i", 3857) + mark + struct.pack(f"{order}II", kind + 3, len(polygons)) + whole


def box(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


@pytest.mark.parametrize("order, kind, turned", [("<", 3, False), (">", 1003, True)])
def test_all_parts_and_holes_count(spark, tmp_path, order, kind, turned):
    grid = Grid((37.55, 55.72, 37.65, 55.78), 500)
    cells = build_grid(spark, grid).collect()
    radius = 6_378_137.0
    sides = {(c["row"], c["col"]): (radius * math.radians(c["x0"]), radius * math.log(math.tan(math.pi / 4 + math.radians(c["y0"]) / 2))) for c in cells}
    (ax, ay), (bx, by) = sides[2, 2], sides[6, 9]
    # 300 m with a hole of 100 m in one cell and 200 m in another: 80,000 and 40,000 square metres.
    hole = box(ax + 150, ay + 150, 100)
    parts = [[box(ax + 50, ay + 50, 300), hole[::-1] if turned else hole], [box(bx + 20, by + 20, 200)[::-1]]]
    path = str(tmp_path / "parts.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('hexes', 'geom')")
        db.execute("create table hexes (fid integer primary key, population real, geom blob)")
        db.execute("insert into hexes values (1, 120.0, ?)", (polygons_blob(parts, order, kind),))
    pieces = {(r["row"], r["col"]): r["share"] for r in overlay(load_population(spark, path), grid).collect() if r["share"] > 1e-9}
    assert pieces == {(2, 2): pytest.approx(2 / 3), (6, 9): pytest.approx(1 / 3)}
    # The box has the second part only.
    cell = next(c for c in cells if (c["row"], c["col"]) == (6, 9))
    assert load_population(spark, path, (cell["x0"], cell["y0"], cell["x1"], cell["y1"])).count() == 1


def test_bad_geometry():
    with pytest.raises(ValueError):
        outer_ring(b"XX")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("grid: {cell_size_m: 250}\noptimize: {weights: {profit: 2.0}}\nunknown: 1\n")
    config = load_config(str(tmp_path / "c.yaml"))
    assert (config.grid.cell_size_m, config.optimize.weights.profit, config.optimize.weights.equity, config.optimize.budget_clinics) == (250, 2.0, 1.0, 8)
    with pytest.raises(FileNotFoundError, match="none.yaml"):
        load_config(str(tmp_path / "none.yaml"))


def test_stages(spark, package, tmp_path):
    (tmp_path / "c.yaml").write_text(f"estimate: {{model: m, cache_dir: {tmp_path}/cache, request_pause_s: 0}}\n")
    config = load_config(str(tmp_path / "c.yaml"))
    grid = grid_of(config)
    points = spark.createDataFrame([("clinic", 37.6, 55.75)], "amenity string, lon double, lat double")
    cells = collect(spark, grid, points, load_population(spark, package, grid.bbox)).cache()
    reply = '{"wealth_score": 5, "area_character": "residential", "confidence": 1}'
    some = estimate(config, cells, lambda: lambda text: reply, limit=100)
    assert some.where("wealth_score = 5").count() == 100 and some.count() == 182
    chosen = optimise(some, grid, budget=3, min_distance_m=1000).collect()
    assert 0 < len(chosen) <= 3


def test_cells_are_written_by_all_tasks(spark, tmp_path):
    write_csv(spark.range(0, 100, 1, 3), str(tmp_path / "cells"), files=None)
    assert len(list((tmp_path / "cells").glob("*.csv"))) == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "cells")).count() == 100
