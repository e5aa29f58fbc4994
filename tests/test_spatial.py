import math
import random

import numpy as np

from pyspark.sql import functions as F

from sitewise.functions.geo import haversine_m, ring_area, to_geographic, to_metric
from sitewise.functions.text import CONTEXT_NONE
from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.overlay import Edges, Rings, descend, _first_pieces, _in_tiles, overlay, pieces, population_sums
from sitewise.operators.spatial import contexts, count_facilities, population_per_cell

GRID = Grid((37.55, 55.72, 37.65, 55.78), 500)
R = 6_378_137.0


def metric(lon, lat):
    return R * math.radians(lon), R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def hexagon(lon, lat, size):
    x, y = metric(lon, lat)
    return [(x + size * math.cos(math.radians(60 * i + 10)), y + size * math.sin(math.radians(60 * i + 10))) for i in range(6)]


def test_pieces_of_a_hexagon_sum_to_it(spark):
    rnd = random.Random(4)
    rows = [(float(i), hexagon(rnd.uniform(37.57, 37.63), rnd.uniform(55.735, 55.765), rnd.uniform(50, 1500))) for i in range(60)]
    hexes = spark.createDataFrame(rows, "population double, ring array<struct<x: double, y: double>>")
    sums = overlay(hexes, GRID).groupBy("population").agg(F.sum("share").alias("s")).collect()
    inside = {i for i, ring in rows if all(metric(GRID.lon_edges[0], GRID.lat_edges[0])[k] < p[k] < metric(GRID.lon_edges[-1], GRID.lat_edges[-1])[k] for p in ring for k in (0, 1))}
    assert len(inside) > 40
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums if r["population"] in inside)


def test_areas(spark):
    rows = [([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)],), ([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)],), ([(0.0, 0.0), (1.0, 1.0)],), ([],)]
    df = spark.createDataFrame(rows, "ring array<struct<x: double, y: double>>")
    got = df.select(ring_area(F.col("ring")).alias("a")).collect()
    assert [r["a"] for r in got] == [16.0, 8.0, 0.0, 0.0]
    flat = [r[0] for r in rows]
    rings = Rings(np.array([x for r in flat for x, _ in r]), np.array([y for r in flat for _, y in r]), np.array([len(r) for r in flat]))
    box = tuple(np.full(4, v) for v in (1.0, 3.0, 1.0, 9.0))
    assert rings.areas().tolist() == [16.0, 8.0, 0.0, 0.0] and _in_tiles(rings, box).areas().tolist() == [6.0, 2.0, 0.0, 0.0]


def star(corners, lon, lat, size):
    """A ring that isn't convex."""
    x, y = metric(lon, lat)
    turn = [2 * math.pi * k / corners for k in range(corners)]
    far = [size * (1 + 0.3 * math.sin(9 * t) + 0.05 * math.cos(151 * t)) for t in turn]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for r, t in zip(far, turn)]


def clipped(ring, x0, y0, x1, y1):
    """The area of a ring's part in a rectangle, a side after the other."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                out.append(tuple(u + a / (a - b) * (v - u) for u, v in zip(p, q)))
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def test_cells_of_any_polygon_are_those_of_plain_clipping(spark, monkeypatch):
    import sitewise.operators.overlay as module

    grid = Grid((37.55, 55.72, 37.63, 55.76), 150)
    hole = [(x, y) for x, y in star(5, 37.59, 55.74, 300)][::-1]
    outer = star(40, 37.59, 55.74, 1400)
    with_hole = [*outer, outer[0], *hole, hole[0], outer[0]]
    rings = [star(60, 37.59, 55.74, 1500), star(300, 37.55, 55.76, 900), star(12, 37.6, 55.73, 20), with_hole, star(7, 37.59, 55.74, 50_000), star(9, 38.5, 55.0, 100)]
    hexes = spark.createDataFrame([(float(i + 1), r) for i, r in enumerate(rings)], "population double, ring array<struct<x: double, y: double>>")
    xs, ys = [metric(v, 55.0)[0] for v in grid.lon_edges], [metric(37.0, v)[1] for v in grid.lat_edges]
    x0, y0 = metric(37.59, 55.74)
    want = {}
    for i, ring in enumerate(rings):
        ring = [(x - x0, y - y0) for x, y in ring]
        whole = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
        for r in range(grid.rows):
            for c in range(grid.columns):
                if (share := clipped(ring, xs[c] - x0, ys[r] - y0, xs[c + 1] - x0, ys[r + 1] - y0) / whole) > 1e-10:
                    want[i + 1, r, c] = share
    sums = {}
    for (i, r, c), share in want.items():
        sums[r, c] = sums.get((r, c), 0.0) + i * share
    for shared in (5, 1):
        monkeypatch.setattr(module, "SHARED", shared)
        monkeypatch.setattr(module, "CORNERS", 100)
        got = {(int(r["population"]), r["row"], r["col"]): r["share"] for r in overlay(hexes, grid).collect() if r["share"] > 1e-10}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        people = {(r["row"], r["col"]): r["people"] for r in population_sums(hexes, grid).collect()}
        assert all(abs(people[k] - sums[k]) < 1e-8 for k in sums)


def test_a_large_polygon_makes_pieces_along_its_outline(spark):
    grid = Grid((37.0, 55.0, 37.0 + 1000 * 500 / (111_320 * math.cos(math.radians(57.25))), 59.5), 500)
    assert grid.rows * grid.columns >= 10**6
    middle = (grid.lon_edges[0] + grid.lon_edges[-1]) / 2
    ring = star(10_000, middle, 57.25, 300_000)
    hexes = spark.createDataFrame([(1e6, ring), (5.0, hexagon(middle, 57.25, 100))], "population double, ring array<struct<x: double, y: double>>")
    made = pieces(hexes, grid, summed=True).cache()
    n = made.count()
    cell = metric(0, 57.25)[1] - metric(0, 57.25 - 500 / 111_320)[1]
    length = sum(math.dist(p, q) for p, q in zip(ring, ring[1:] + ring[:1])) / cell
    assert n < 8 * length, (n, length)
    # Rings are cut once a level: what is handed on holds the outline and the tiles' corners, not a ring for each cell.
    edges = Edges(grid)
    x, y = (np.array(v) - o for v, o in zip(zip(*ring), edges.origin))
    corners = sum(len(p.rings.x) for _, p, _, _ in descend(_first_pieces(Rings(x, y, np.array([len(x)])), edges), edges, -1))
    assert corners < 12 * length + 20_000
    assert made.where("density > 0 and level > 3").count() > 0
    total = population_sums(hexes, grid).agg(F.sum("people")).collect()[0][0]
    assert abs(total - 1_000_005.0) < 1e-3
    made.unpersist()


def test_projection_and_back(spark):
    df = spark.createDataFrame([([(37.6, 55.75), (37.61, 55.76)],)], "ring array<struct<x: double, y: double>>")
    back = df.select(to_geographic(to_metric(F.col("ring"))).alias("r")).collect()[0]["r"]
    assert all(abs(a - b) < 1e-9 for p, q in zip(back, [(37.6, 55.75), (37.61, 55.76)]) for a, b in zip(p, q))


def test_rounding_is_half_to_even_and_empty_is_zero(spark):
    centres = build_grid(spark, GRID).orderBy("cell_id").limit(3).collect()
    rows = [(p, hexagon(c["center_lon"], c["center_lat"], 50)) for p, c in zip((0.5, 1.5, 2.5), centres)]
    hexes = spark.createDataFrame(rows, "population double, ring array<struct<x: double, y: double>>")
    got = [r["population"] for r in population_per_cell(build_grid(spark, GRID), hexes, GRID).orderBy("cell_id").limit(4).collect()]
    assert got == [0, 2, 2, 0]


def test_contexts(spark):
    c = build_grid(spark, GRID).where("cell_id = 'cell_000000'").collect()[0]
    kinds = [None, "clinic", "clinic", "dentist", "", "vet"]
    points = spark.createDataFrame([(k, c["center_lon"], c["center_lat"]) for k in kinds], "amenity string, lon double, lat double")
    cells = build_grid(spark, GRID)
    got = {r["cell_id"]: r["context"] for r in contexts(cells, points, GRID).collect()}
    assert got["cell_000000"] == "Рядом медучреждений: 6 (клиники: 2, прочее: 1, стоматологии: 1, vet: 1)."
    assert got["cell_000001"] == CONTEXT_NONE
    alone = {r["cell_id"]: r["context"] for r in contexts(cells, points.where("amenity is null"), GRID).collect()}
    assert alone["cell_000000"] == "Рядом медучреждений: 1 ()."
    none = points.limit(0)
    assert {r["existing_clinics"] for r in count_facilities(cells, none, GRID).collect()} == {0}


def test_haversine(spark):
    got = spark.range(1).select(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).collect()[0][0]
    assert abs(got - 6_371_000 * math.pi / 180) < 1e-6
