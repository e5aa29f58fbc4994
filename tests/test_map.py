"""The tile pyramid and the page that reads it."""

import json
import math

import pytest

from pyspark.sql import functions as F

from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.report import tiled_page
from sitewise.operators.tiles import CELLS, levels, tile_features, write_tiles


def tile(lon, lat, z):
    return math.floor((lon / 360 + 0.5) * 2**z), math.floor((0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)) * 2**z)


@pytest.fixture(scope="module")
def cells(spark):
    grid = Grid((37.0, 55.0, 38.2, 55.7), 500)
    numbers = {"population": (F.col("row") * 7 + F.col("col")).cast("bigint"), "existing_clinics": (F.col("col") % 3).cast("bigint"), "wealth_score": F.when(F.col("row") % 5 != 0, F.col("col") % 11)}
    return grid, build_grid(spark, grid).withColumns(numbers)


def test_levels_add_up_to_the_cells(spark, cells):
    grid, table = cells
    coarse, finest = levels(grid)
    assert coarse < finest and levels(Grid((37.55, 55.72, 37.65, 55.78), 500)) == (13, 13)
    rows = table.collect()
    found = tile_features(table, grid).collect()
    for z in range(coarse, finest + 1):
        side, want = 2 ** (finest - z), {}
        for r in rows:
            want.setdefault((r["row"] // side, r["col"] // side), []).append(r)
        got = {(f["row"], f["col"]): f for f in found if f["z"] == z}
        assert got.keys() == want.keys()
        for k, own in want.items():
            f, known = got[k], [r["wealth_score"] for r in own if r["wealth_score"] is not None]
            box = (min(r["x0"] for r in own), min(r["y0"] for r in own), max(r["x1"] for r in own), max(r["y1"] for r in own))
            assert (f["cells"], f["population"], f["existing_clinics"]) == (len(own), sum(r["population"] for r in own), sum(r["existing_clinics"] for r in own))
            assert (f["x0"], f["y0"], f["x1"], f["y1"]) == box and (f["x"], f["y"]) == tile((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, z)
            assert f["wealth_score"] == (pytest.approx(sum(known) / len(known)) if known else None)
    by_tile = {}
    for f in found:
        by_tile[f["z"], f["x"], f["y"]] = by_tile.get((f["z"], f["x"], f["y"]), 0) + 1
    assert max(by_tile.values()) <= (CELLS + 1) ** 2 and sum(z == coarse for z, _, _ in by_tile) <= 6


def test_tile_files_hold_all_features(spark, cells, tmp_path):
    grid, table = cells
    path = str(tmp_path / "tiles")
    assert write_tiles(table, grid, path) == levels(grid)
    write_tiles(table, grid, path)  # again, in place
    want = {}
    for f in tile_features(table, grid).collect():
        want.setdefault((f["z"], f["x"], f["y"]), []).append(f)
    files = {tuple(map(int, p.relative_to(path).with_suffix("").parts)): json.loads(p.read_text()) for p in (tmp_path / "tiles").rglob("*.json")}
    assert files.keys() == want.keys() and not [p for p in (tmp_path / "tiles").rglob(".*") if p.suffix != ".crc"]
    for k, collection in files.items():
        own = sorted(want[k], key=lambda f: (f["row"], f["col"]))
        assert collection["type"] == "FeatureCollection" and [f["properties"]["population"] for f in collection["features"]] == [f["population"] for f in own]
        assert collection["features"][0]["geometry"]["coordinates"][0][2] == [round(own[0]["x1"], 6), round(own[0]["y1"], 6)]


def test_page(spark, cells):
    grid, table = cells
    chosen = table.limit(2).select("cell_id", "center_lon", "center_lat", F.lit("public").alias("facility_type"), F.lit(0.5).alias("best_score"))
    html = tiled_page(chosen, grid, tiles="../tiles", base="https://example.org/{z}/{x}/{y}.png").first()["html"]
    assert '"../tiles"' in html and "example.org/{z}" in html and "cell_000000" in html and "const markers=[{" in html and "__" not in html
    assert "const markers=[]" in tiled_page(chosen.limit(0), grid, tiles="t").first()["html"]
