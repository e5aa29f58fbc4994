import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitewise.operators.access import baseline_placement, before_after, mean_access_time, nearest_times
from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.report import geojson_features, legend, map_page, markers
from sitewise.operators.stats import equal_histogram, hide_facilities, spearman, spearman_vs_price, type_agreement, unit_histogram

GRID = Grid((37.55, 55.72, 37.65, 55.78), 500)


def way(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(a)) / 1000 / 25 * 60


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("points", [[(37.6, 55.75)], [(36.0, 54.0), (39.5, 56.0)], "many", "corner"])
def test_nearest_equals_all_pairs(spark, points, most):
    rnd = random.Random(7)
    if points == "many":
        points = [(rnd.uniform(37.5, 37.7), rnd.uniform(55.7, 55.8)) for _ in range(200)]
    elif points == "corner":
        points = [(37.9 + rnd.random() / 100, 55.9 + rnd.random() / 100) for _ in range(100)]
    cells = build_grid(spark, GRID)
    got = {r["cell_id"]: r["minutes"] for r in nearest_times(cells, spark.createDataFrame([*points, points[0], (None, 55.7), (37.6, None), (float("nan"), 55.7)], "lon double, lat double"), GRID, most_points=most).collect()}
    for c in cells.collect():
        assert got[c["cell_id"]] == pytest.approx(min(way(c["center_lon"], c["center_lat"], *p) for p in points), abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 900])
def test_tree_equals_all_pairs(n, monkeypatch):
    import sitewise.operators.nearest as module

    rng = np.random.default_rng(n)
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lon[::3], lat[::3] = lon[0], lat[0]  # many at one place
    if n > 2:
        lat[1] = 90.0
    tree = module.Tree.of(lon, lat)
    assert sorted(zip(tree.lon, tree.lat)) == sorted(zip(lon, lat)) and (tree.end[-(2**tree.levels):] - tree.begin[-(2**tree.levels):]).max() <= 16
    x, y = np.concatenate([rng.uniform(-180, 180, 300), [180, -180, 0, lon[0]]]), np.concatenate([rng.uniform(-90, 90, 300), [0, 0, -90, lat[0]]])
    want = ((module.on_sphere(x, y)[:, None] - module.on_sphere(lon, lat)[None]) ** 2).sum(axis=2).min(axis=1)
    for pairs in (1 << 18, 7):
        monkeypatch.setattr(module, "PAIRS", pairs)
        at = tree.nearest(x, y)
        assert np.allclose(((module.on_sphere(x, y) - module.on_sphere(tree.lon[at], tree.lat[at])) ** 2).sum(axis=1), want, atol=1e-15)


def test_queries_without_a_place(spark):
    from sitewise.operators.nearest import small_tree, with_nearest

    points = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (50.0, 5.0)], "lon double, lat double")
    assert small_tree(points, 1) is None and small_tree(points.limit(0)) is None
    asked = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, 1.0), ("c", 60.0, 5.0)], "name string, x double, y double")
    assert sorted(map(tuple, with_nearest(asked, small_tree(points, 2), lon="x", lat="y").select("name", "_lon", "_lat").collect())) == [("a", 1.0, 2.0), ("b", None, None), ("c", 50.0, 5.0)]


def test_means(spark):
    cells = build_grid(spark, GRID).limit(3).withColumn("population", F.lit(0).cast("bigint"))
    one = spark.createDataFrame([(37.6, 55.75)], "lon double, lat double")
    times = [r["minutes"] for r in nearest_times(cells, one, GRID).collect()]
    assert mean_access_time(cells, one, GRID).collect()[0][0] == pytest.approx(sum(times) / 3)
    assert mean_access_time(cells, one.limit(0), GRID).collect()[0][0] is None
    new = cells.select("cell_id", "center_lon", "center_lat")
    got = before_after(cells, one, new, GRID).collect()[0]
    assert got["after"] == 0.0 and got["improvement"] == got["before"]


def test_baselines(spark):
    cells = spark.createDataFrame([(f"c{i}", 0.0, 0.0, p) for i, p in enumerate((1, 3, 3, 3))], "cell_id string, center_lon double, center_lat double, population bigint")
    assert [r["cell_id"] for r in baseline_placement(cells, 2).collect()] == ["c1", "c2"]
    assert baseline_placement(cells, 3, "random").count() == 3
    with pytest.raises(ValueError):
        baseline_placement(cells, 5, "random")


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 5.0), (4.0, 9.0), (None, 1.0)], "x double, y double")
    got = spearman(df, "x", "y").collect()[0]
    rx, ry = [1, 2.5, 2.5, 4], [2, 1, 3, 4]
    mx = [v - 2.5 for v in rx], [v - 2.5 for v in ry]
    want = sum(a * b for a, b in zip(*mx)) / math.sqrt(sum(a * a for a in mx[0]) * sum(b * b for b in mx[1]))
    assert got["n"] == 4 and got["rho"] == pytest.approx(want)
    assert spearman(df.withColumn("x", F.lit(1.0)), "x", "y").collect()[0]["rho"] is None
    assert spearman(df.limit(0), "x", "y").collect()[0]["n"] == 0


def test_p_value(spark):
    cells = spark.createDataFrame([(str(i), float(i)) for i in range(5)], "cell_id string, wealth_score double")
    prices = spark.createDataFrame([(str(i), float(p)) for i, p in enumerate((1, 3, 2, 5, 4))], "cell_id string, price_per_m2 double")
    got = spearman_vs_price(cells, prices).collect()[0]
    # rho 0.8 and three degrees of freedom: t = 2.3094, for which the distribution has a closed form.
    t = 0.8 * math.sqrt(3 / (1 - 0.64))
    want = 1 - 2 / math.pi * (t / math.sqrt(3) / (1 + t * t / 3) + math.atan(t / math.sqrt(3)))
    assert got["rho"] == pytest.approx(0.8) and got["p_value"] == pytest.approx(want, abs=1e-12)


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 10.0, 11.0, 12.0, None)], "x double")
    assert [r["n"] for r in unit_histogram(df, "x", 0, 11).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    got = equal_histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 3] and (got[0]["low"], got[3]["high"]) == (0.0, 12.0)
    same = equal_histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["n"]) for r in same] == [(2.5, 0), (3.0, 2)]


def test_backtest_helpers(spark):
    registry = spark.createDataFrame([(f"n{i}", "public") for i in range(200)], "name string, facility_type string")
    facilities = registry.select("name")
    left, known, hidden = hide_facilities(facilities, registry, 0.2)
    assert 20 < hidden.count() < 60 and left.count() == known.count() == 200 - hidden.count()
    p = spark.createDataFrame([(1, "public"), (2, "private"), (3, "public")], "id int, facility_type string")
    t = spark.createDataFrame([(1, "public"), (2, "public"), (3, "private")], "id int, facility_type string")
    got = type_agreement(p, t).collect()[0]
    assert (got["n"], got["accuracy"], got["f1_public"]) == (3, pytest.approx(1 / 3), 0.5)


def test_report_files(spark, tmp_path):
    import json

    from sitewise.operators.report import write_csv, write_geojson
    from sitewise.sources.tables import load_recommended

    cells = build_grid(spark, GRID).withColumns({"population": F.lit(1), "existing_clinics": F.lit(0), "wealth_score": F.lit(None).cast("int")})
    chosen = cells.limit(2).select("cell_id", "center_lon", "center_lat", F.lit("public").alias("facility_type"), F.lit(0.5).alias("best_score"))
    feature = json.loads(geojson_features(cells).orderBy("cell_id").first()["feature"])
    assert feature["properties"] == {"cell_id": "cell_000000", "population": 1, "existing_clinics": 0, "wealth_score": None} and len(feature["geometry"]["coordinates"][0]) == 5
    assert markers(chosen).first()["radius"] == 11.0 and {(r["facility_type"], r["n"]) for r in legend(chosen).collect()} == {("public", 2), ("private", 0)}
    assert "cell_000000" in map_page(chosen, cells).first()["html"]
    write_csv(chosen, str(tmp_path / "c"))
    assert load_recommended(spark, str(tmp_path / "c")).collect() == chosen.collect()
    write_geojson(cells, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 182
