import math

import pytest

from sitewise.operators.grid import Grid, build_grid, locate

GRID = Grid((37.55, 55.72, 37.65, 55.78), 500)


def test_default_grid(spark):
    cells = build_grid(spark, GRID).orderBy("cell_id").collect()
    assert (GRID.rows, GRID.columns, len(cells)) == (14, 13, 182)
    assert [c["cell_id"] for c in cells] == [f"cell_{i:06d}" for i in range(182)]
    lat, edges = 55.72, []
    while lat < 55.78:
        edges.append(lat)
        lat += 500 / 111_320
    assert sorted({c["y0"] for c in cells}) == edges
    assert all(c["center_lat"] == c["y0"] + 500 / 111_320 / 2 for c in cells)


def test_neighbours_share_edges(spark):
    cells = {(c["row"], c["col"]): c for c in build_grid(spark, GRID).collect()}
    assert all(cells[r, c]["x1"] == cells[r, c + 1]["x0"] for r, c in cells if (r, c + 1) in cells)
    assert all(cells[r, c]["y1"] == cells[r + 1, c]["y0"] for r, c in cells if (r + 1, c) in cells)


def test_points_on_edges_and_outside_go(spark):
    x, y = GRID.lon_edges, GRID.lat_edges
    points = [(1, x[3], y[2] + 1e-5), (2, x[3] + 1e-12, y[2] + 1e-5), (3, x[3] - 1e-12, y[2] + 1e-5), (4, x[0], y[0]), (5, x[-1] + 1, y[1]), (6, None, y[1]), (7, math.nextafter(x[0], 99), math.nextafter(y[0], 99))]
    got = {r["i"]: (r["row"], r["col"]) for r in locate(spark.createDataFrame(points, "i int, lon double, lat double"), GRID).collect()}
    assert got == {2: (2, 3), 3: (2, 2), 7: (0, 0)}


def test_every_cell_finds_its_own_centre(spark):
    cells = build_grid(spark, GRID)
    found = locate(cells.select("cell_id", "center_lon", "center_lat"), GRID, lon="center_lon", lat="center_lat")
    assert found.where(found["cell_id"] == GRID.cell_id(found["row"], found["col"])).count() == 182


def test_too_fine_a_grid_is_refused():
    with pytest.raises(ValueError):
        Grid((0, 0, 90, 45), 1).lat_edges
