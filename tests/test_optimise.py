import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.scores import filter_candidates, normalize, with_facility_type, with_scores
from sitewise.operators.selection import best_choice, cliques, conflict_pairs, explore, greedy, most_conflicts, pose, select_sites

GRID = Grid((37.55, 55.72, 37.65, 55.78), 500)


def scaled(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r["y"] for r in normalize(df, y="x").orderBy("i").collect()]


def test_normalize(spark):
    assert scaled(spark, [3.0, 3.0]) == [0.0, 0.0]
    assert scaled(spark, [3.0, None, 3.0]) == [0.0, 0.0, 0.0]
    assert scaled(spark, [1.0, None, 3.0]) == [0.0, None, 1.0]
    assert scaled(spark, [1.0, math.nan, 2.0]) == [0.0, None, 1.0]
    assert scaled(spark, [None, None]) == [None, None]
    assert scaled(spark, []) == []


def test_types(spark):
    rows = [("a", 0.5, 0.5), ("b", 0.2, 0.9), ("c", 0.4, None)]
    got = {r["c"]: (r["facility_type"], r["best_score"]) for r in with_facility_type(spark.createDataFrame(rows, "c string, equity double, profit double")).collect()}
    assert got == {"a": ("public", 0.5), "b": ("private", 0.9), "c": ("private", 0.4)}


def test_scores_and_candidates(spark):
    rows = [("a", 100, 0, 5, "mixed"), ("b", 50, 1, 10, None), ("c", 10, 3, None, "industrial")]
    cells = spark.createDataFrame(rows, "cell_id string, population bigint, existing_clinics bigint, wealth_score int, area_character string")
    got = {r["cell_id"]: r for r in with_scores(cells).collect()}
    assert got["a"]["equity"] == 1.0 and got["c"]["equity"] == 0.0 and got["c"]["profit"] is None
    assert {r["cell_id"] for r in filter_candidates(cells).collect()} == {"a", "b"}


def test_conflicts(spark):
    pairs = {(r[0], r[1]) for r in conflict_pairs(build_grid(spark, GRID), GRID, 1000).collect()}
    at = lambda r, c: f"cell_{r * 13 + c:06d}"
    assert (at(0, 0), at(2, 0)) in pairs and (at(0, 0), at(0, 2)) in pairs and (at(0, 0), at(1, 1)) in pairs
    assert (at(0, 0), at(1, 2)) not in pairs and (at(0, 0), at(2, 1)) not in pairs
    assert len(pairs) == 959 and most_conflicts(GRID, 1000) == 12


def problems(many, most=9):
    """(problem, the best total, the set of that total that comes first) of random scores with ties and conflicts."""
    rnd = random.Random(1)
    for _ in range(many):
        n, budget = rnd.randint(1, most), rnd.randint(1, 4)
        scores = sorted((rnd.randint(1, 6) / 4 for _ in range(n)), reverse=True)
        blocked = [set() for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rnd.random() < 0.4:
                blocked[a].add(b)
                blocked[b].add(a)
        sets = [s for k in range(1, budget + 1) for s in itertools.combinations(range(n), k) if all(b not in blocked[a] for a, b in itertools.combinations(s, 2))]
        top = max(sum(scores[i] for i in s) for s in sets)
        yield pose(np.array(scores), [np.array(sorted(x), int) for x in blocked], budget), top, min(s for s in sets if sum(scores[i] for i in s) == top)


def test_search_equals_brute_force():
    for visits in (1, 3, 10**6):
        for problem, top, want in problems(150):
            best, nodes = greedy(problem.scores, problem.blocked, problem.budget), [((), 0)]
            while nodes:
                best, still = explore(problem, nodes, best, visits)
                nodes = [(chosen, at) for chosen, at, _ in still]
            assert best == (top, want)


def test_cliques_cover_all_conflicts():
    for problem, _, _ in problems(60, 14):
        found = cliques(problem.blocked)
        pairs = {p for c in found for p in itertools.combinations(c, 2)}
        assert pairs == {(a, int(b)) for a, near in enumerate(problem.blocked) for b in near if a < b}
        free = np.ones(len(problem.scores), bool)
        assert problem.bound(0.0, free, problem.budget) >= greedy(problem.scores, problem.blocked, problem.budget)[0] - 1e-12


def test_rounds_of_tasks_hand_back_open_nodes(spark):
    for problem, top, want in list(problems(40, 12))[-4:]:
        assert best_choice(spark, problem, visits=2) == (top, want)


def smooth(grid, column):
    """Scores in waves, so that neighbours have nearly the same."""
    return (2 + F.sin(F.col("row") / 5.0) * F.cos(F.col("col") / 4.0) + F.sin((F.col("row") + 2 * F.col("col")) / 7.0)).alias(column)


def test_a_large_grid_ends_with_an_optimum(spark):
    grid = Grid((37.55, 55.72, 37.55 + 39.5 * GRID.lon_step, 55.72 + 39.5 * GRID.lat_step), 500)
    assert (grid.rows, grid.columns) == (40, 40)
    cells = build_grid(spark, grid).withColumns({"best_score": smooth(grid, "best_score"), "facility_type": F.lit("public")})
    got = select_sites(cells, grid, budget=12, min_distance_m=1000).collect()
    again = select_sites(cells, grid, budget=12, min_distance_m=1000, visits=40).collect()
    assert len(got) == 12 and got == again and all(r["optimal"] for r in got)
    near = {(r[0], r[1]) for r in conflict_pairs(cells, grid, 1000).collect()}
    assert not any(tuple(sorted(p)) in near for p in itertools.combinations([r["cell_id"] for r in got], 2))
    # Better than the best free cell again and again.
    left, total = sorted(cells.select("cell_id", "best_score").collect(), key=lambda r: (-r[1], r[0])), 0.0
    for _ in range(12):
        total += left[0][1]
        left = [r for r in left if r[0] != left[0][0] and tuple(sorted((r[0], left[0][0]))) not in near]
    assert sum(r["best_score"] for r in got) > total


@pytest.mark.parametrize("budget", [1, 3])
def test_selection_on_a_small_grid(spark, budget):
    grid = Grid((37.55, 55.72, 37.58, 55.735), 500)
    cells = build_grid(spark, grid).withColumns({"best_score": (F.xxhash64("cell_id") % 1000 + 1000) / 2000, "facility_type": F.lit("public")})
    rows = sorted(cells.collect(), key=lambda r: (-r["best_score"], r["cell_id"]))
    near = {(r[0], r[1]) for r in conflict_pairs(cells, grid, 1000).collect()}
    best = max(
        (sum(r["best_score"] for r in s), [-rows.index(r) for r in s]) for k in range(1, budget + 1) for s in itertools.combinations(rows, k)
        if not any(tuple(sorted((a["cell_id"], b["cell_id"]))) in near for a, b in itertools.combinations(s, 2))
    )
    got = select_sites(cells, grid, budget=budget, min_distance_m=1000).collect()
    assert sum(r["best_score"] for r in got) == pytest.approx(best[0]) and all(r["optimal"] for r in got)
    assert select_sites(cells.withColumn("best_score", F.lit(0.0)), grid, budget=2, min_distance_m=1000).count() == 0
