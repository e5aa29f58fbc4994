"""Ways over a network against Dijkstra's algorithm."""

import heapq
import random

import pytest

from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.network import network_matrix, network_times, shortest
from test_access_and_stats import way

EDGES = "a bigint, b bigint, minutes double"


def dijkstra(edges, starts):
    out = {}
    for a, b, m in edges:
        if m is not None:
            out.setdefault(a, []).append((b, m))
    known, waiting = {}, [(m, n) for n, m in starts]
    heapq.heapify(waiting)
    while waiting:
        m, n = heapq.heappop(waiting)
        if n in known:
            continue
        known[n] = m
        for b, w in out.get(n, ()):
            heapq.heappush(waiting, (m + w, b))
    return known


def graph(seed, nodes=60, edges=150):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes), rnd.choice([0.0, 1.0, rnd.random() * 5])) for _ in range(edges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_equals_dijkstra(spark, seed):
    edges = graph(seed)
    table = spark.createDataFrame([*edges, edges[0], (0, 1, None), (None, 1, 1.0)], EDGES)
    starts = [("x", 0, 0.0), ("x", 5, 2.5), ("y", 7, 1.0), ("z", 999, 0.0), ("y", 3, None)]
    start = spark.createDataFrame(starts, "src string, node bigint, minutes double")
    want = {(s, n): m for s in "xyz" for n, m in dijkstra(edges, [(n, m) for t, n, m in starts if t == s and m is not None]).items()}
    got = {(r["src"], r["node"]): r["minutes"] for r in shortest(table, start).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    some = [0, 11, 23, 999, 5000]
    targets = spark.createDataFrame([(n,) for n in some], "node bigint")
    got = {(r["src"], r["node"]): r["minutes"] for r in shortest(table, start, targets).collect()}
    assert got == {k: pytest.approx(m) for k, m in want.items() if k[1] in some}
    near = [n for s, n in want if s == "x"][:3]  # all reached: the search may end early
    got = {r["node"]: r["minutes"] for r in shortest(table, start.where("src = 'x'"), spark.createDataFrame([(n,) for n in near], "node bigint")).collect()}
    assert got == {n: pytest.approx(want["x", n]) for n in near}


def test_no_start_and_no_edges(spark):
    start = spark.createDataFrame([(1, 2, 0.5)], "src int, node bigint, minutes double")
    edges = spark.createDataFrame([], EDGES)
    assert [tuple(r) for r in shortest(edges, start).collect()] == [(1, 2, 0.5)] and shortest(edges, start.limit(0)).count() == 0


def test_cells_and_pairs_over_a_network(spark):
    grid = Grid((37.55, 55.72, 37.58, 55.735), 500)
    rnd = random.Random(3)
    places = {k: (37.55 + rnd.random() * 0.03, 55.72 + rnd.random() * 0.015) for k in range(30)}
    edges = [(a, b, 2 * way(*places[a], *places[b])) for a, b in ((rnd.randrange(29), rnd.randrange(29)) for _ in range(90))]
    nodes = spark.createDataFrame([(k, *p) for k, p in places.items()], "node bigint, lon double, lat double")
    table = spark.createDataFrame(edges, EDGES)
    facilities = [(37.556, 55.723), (37.572, 55.731), (None, 55.7)]
    snap = lambda p: min(places, key=lambda k: way(*p, *places[k]))
    starts = [(snap(f), way(*f, *places[snap(f)])) for f in facilities if f[0]]
    known = dijkstra(edges, starts)
    cells = build_grid(spark, grid)
    got = {r["cell_id"]: r["minutes"] for r in network_times(cells, spark.createDataFrame(facilities, "lon double, lat double"), nodes, table).collect()}
    for c in cells.collect():
        n = snap((c["center_lon"], c["center_lat"]))
        want = known[n] + way(c["center_lon"], c["center_lat"], *places[n]) if n in known else None
        assert got[c["cell_id"]] == (None if want is None else pytest.approx(want)), c["cell_id"]
    sources = spark.createDataFrame([("s0", *facilities[0]), ("s1", *facilities[1])], "src string, lon double, lat double")
    ends = {"d0": (37.56, 55.73), "d1": (37.575, 55.722), "d2": (37.57, 55.728)}
    pairs = {(r["src"], r["dst"]): r["minutes"] for r in network_matrix(sources, spark.createDataFrame([(d, *p) for d, p in ends.items()], "dst string, lon double, lat double"), nodes, table).collect()}
    want = {}
    for i, s in enumerate(starts):
        reach = dijkstra(edges, [s])
        want |= {(f"s{i}", d): reach[snap(p)] + way(*p, *places[snap(p)]) for d, p in ends.items() if snap(p) in reach}
    assert pairs == {k: pytest.approx(v) for k, v in want.items()} and want
