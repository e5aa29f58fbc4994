"""Site selection: the best set of at most ``budget`` cells of which no two are too near.

An exact search over a proven kernel. If no cell has more than d cells in its way,
the first (budget - 1) * (d + 1) + 1 cells by score hold an optimum: a chosen cell
outside them could be swapped for one inside that no other chosen cell blocks and that
scores no less. So Spark cuts the table down to a number of rows that the settings
and the grid alone set, and finds the conflicts among them.

The search is a branch and bound in rounds over a table of open nodes. A task takes its share
of them and the best set known so far, searches a fixed number of nodes and hands back the
best it has found with the nodes that are still open; what can't win any more goes, the rest is
dealt out anew. It ends when no node is open, so the set is always an optimum. Bounds come from
prices on cliques of cells that are all in one another's way: at most one cell of each can be chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.durable import forget, written
from sitewise.functions.geo import EARTH_M, haversine_m
from sitewise.operators.grid import Grid

#: Nodes that a task visits in a round, some seconds' work; the others are dealt out anew.
VISITS = 20_000
#: Steps towards the best prices.
PRICE_STEPS = 400
#: Totals so near are equal.
SAME = 1e-12


def reach(grid: Grid, min_distance_m: float) -> tuple[int, int]:
    """Rows and columns within which a nearer cell can lie."""
    high = max(abs(grid.lat_edges[0]), abs(grid.lat_edges[-1]))
    meters = math.radians(1) * EARTH_M
    return math.ceil(min_distance_m / (grid.lat_step * meters)) + 1, math.ceil(min_distance_m / (grid.lon_step * meters * math.cos(math.radians(high)))) + 1


def conflict_pairs(cells: DataFrame, grid: Grid, min_distance_m: float) -> DataFrame:
    """(cell_a, cell_b), a before b by id, of cells whose centres are nearer than the limit.

    A cell is joined with its neighbourhood by row and column; only those pairs
    are measured. Needs cell_id, row, col, center_lon, center_lat.
    """
    up, side = reach(grid, min_distance_m)
    own = cells.select("cell_id", "row", "col", "center_lon", "center_lat")
    # Half of the neighbourhood: each pair of places once.
    offsets = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(up)), lambda r: F.transform(F.sequence(F.lit(-side), F.lit(side)), lambda c: F.struct(r.alias("r"), c.alias("c"))))),
        lambda o: (o["r"] > 0) | (o["c"] > 0),
    )
    spread = own.withColumn("_o", F.explode(offsets)).select(
        F.col("cell_id").alias("a"), (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"), F.col("center_lon").alias("_lon"), F.col("center_lat").alias("_lat")
    )
    near = spread.join(own, ["row", "col"]).where(haversine_m(F.col("_lon"), F.col("_lat"), F.col("center_lon"), F.col("center_lat")) < min_distance_m)
    return near.select(F.least("a", "cell_id").alias("cell_a"), F.greatest("a", "cell_id").alias("cell_b"))


def most_conflicts(grid: Grid, min_distance_m: float) -> int:
    """An upper bound on the cells in any cell's way: where columns are narrowest, near the pole-side edge."""
    up, side = reach(grid, min_distance_m)
    lat = max(abs(grid.lat_edges[0]), abs(grid.lat_edges[-1]))
    n = 0
    for r in range(-up, up + 1):
        for c in range(-side, side + 1):
            # Between two centres so far apart it is no shorter than with both at the narrowest latitude.
            dy = math.sin(math.radians(r * grid.lat_step) / 2) ** 2
            dx = math.sin(math.radians(c * grid.lon_step) / 2) ** 2 * math.cos(math.radians(lat)) ** 2
            n += (r, c) != (0, 0) and 2 * EARTH_M * math.asin(min(1.0, math.sqrt(dy + dx))) < min_distance_m * (1 + 1e-9)
    return n


#: A set of places in order with its total, and a node: a set, and the first place that may be added.
Choice = tuple[float, tuple[int, ...]]
Node = tuple[tuple[int, ...], int]


@dataclass(frozen=True)
class Problem:
    """Places by falling score, those in each one's way, and priced cliques: places, where each begins, prices, scores less prices."""

    scores: np.ndarray
    blocked: list[np.ndarray]
    budget: int
    members: np.ndarray
    begins: np.ndarray
    prices: np.ndarray
    reduced: np.ndarray

    def bound(self, value: float, free: np.ndarray, left: int) -> float:
        """No set of the chosen places and ``left`` free ones is worth more."""
        places = np.flatnonzero(free)
        plain = self.scores[places[:left]].sum()
        if not len(self.prices):
            return value + plain
        own = self.reduced[places]
        if len(own) > left:
            own = np.partition(own, len(own) - left)[-left:]
        # A clique without a free place costs nothing.
        met = np.logical_or.reduceat(free[self.members], self.begins)
        return value + min(plain, own[own > 0].sum() + self.prices[met].sum())


def cliques(blocked: list[np.ndarray]) -> list[list[int]]:
    """Sets of places that are all in one another's way; each pair in conflict is in one."""
    near = [set(b.tolist()) for b in blocked]
    covered: set[tuple[int, int]] = set()
    found = []
    for a, others in enumerate(near):
        for b in sorted(x for x in others if x > a):
            if (a, b) in covered:
                continue
            clique, common = [a, b], near[a] & near[b]
            while common:
                # The place that leaves most of the others.
                c = max(common, key=lambda x: (len(common & near[x]), -x))
                clique.append(c)
                common = common & near[c]
            clique.sort()
            covered.update((x, y) for i, x in enumerate(clique) for y in clique[i + 1 :])
            found.append(clique)
    return found


def greedy(scores: np.ndarray, blocked: list[np.ndarray], budget: int) -> Choice:
    """The best free place again and again: of sets of its total the first in order."""
    free, chosen, value = np.ones(len(scores), bool), [], 0.0
    for k in range(len(scores)):
        if free[k] and len(chosen) < budget:
            chosen.append(k)
            value += float(scores[k])
            free[blocked[k]] = False
    return value, tuple(chosen)


def pose(scores: np.ndarray, blocked: list[np.ndarray], budget: int) -> Problem:
    """The problem with prices that lower the bound on all sets by steps along its slope."""
    found = cliques(blocked)
    n = len(scores)
    members = np.array([k for c in found for k in c], int)
    begins = np.cumsum([0] + [len(c) for c in found])[:-1].astype(int)
    of = np.repeat(np.arange(len(found)), [len(c) for c in found]) if found else np.empty(0, int)
    prices = np.zeros(len(found))
    best = (math.inf, prices, scores)
    known, step = greedy(scores, blocked, budget)[0], 1.0
    for k in range(PRICE_STEPS if found else 0):
        reduced = scores - np.bincount(members, prices[of], n)
        top = np.argsort(-reduced, kind="stable")[:budget]
        top = top[reduced[top] > 0]
        bound = reduced[top].sum() + prices.sum()
        if bound < best[0]:
            best = bound, prices, reduced
        elif k % 20 == 19:
            step /= 2
        picked = np.zeros(n)
        picked[top] = 1
        slope = 1 - np.bincount(of, picked[members], len(found))
        slope[(prices == 0) & (slope > 0)] = 0
        length = (slope**2).sum()
        if length == 0 or bound - known <= SAME:
            break
        prices = np.maximum(0, prices - step * (bound - known) / length * slope)
    return Problem(scores, blocked, budget, members, begins, best[1], best[2])


def _wins(value: float, chosen: tuple[int, ...], best: Choice) -> bool:
    """Sums of the same scores in another order differ in their last bits: of those within SAME the first in order wins."""
    return value > best[0] + SAME or (value >= best[0] - SAME and chosen < best[1])


def _hopeless(bound: float, chosen: tuple[int, ...], at: int, best: Choice) -> bool:
    if bound > best[0] + SAME:
        return False
    # At most as good: only sets that come first in order could still win.
    return bound < best[0] - SAME or (*chosen, at) > best[1][: len(chosen) + 1]


def explore(problem: Problem, nodes: list[Node], best: Choice, visits: int) -> tuple[Choice, list[tuple[tuple[int, ...], int, float]]]:
    """The best choice of those known and found in so many visits, and the nodes still open with their bounds."""
    stack = list(nodes)[::-1]

    def look(chosen: tuple[int, ...], at: int) -> tuple[float, np.ndarray, float]:
        """The set's total, the places that may be added, and a bound."""
        free = np.ones(len(problem.scores), bool)
        free[:at] = False
        value = 0.0
        for k in chosen:
            value += float(problem.scores[k])
            free[problem.blocked[k]] = False
        left = problem.budget - len(chosen)
        return value, free, problem.bound(value, free, left) if left and free.any() else value

    while stack and visits > 0:
        visits -= 1
        chosen, at = stack.pop()
        value, free, bound = look(chosen, at)
        if len(chosen) == problem.budget or not free.any():
            continue
        k = int(free.argmax())
        if _hopeless(bound, chosen, k, best):
            continue
        more = value + float(problem.scores[k])
        if _wins(more, (*chosen, k), best):
            best = more, (*chosen, k)
        stack += [(chosen, k + 1), ((*chosen, k), k + 1)]
    still = [(chosen, at, look(chosen, at)[2]) for chosen, at in stack]
    return best, [n for n in still if not _hopeless(n[2], n[0], n[1], best)]


def _round(problem, best: Choice, visits: int):
    """Rows of a task: its best choice if it is a better one, and its open nodes (place ``at``) with their bounds."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = [(r.bound, tuple(r.chosen), int(r.at)) for f in frames for r in f.itertuples()]
        nodes.sort(key=lambda n: (-n[0], n[1]))
        found, still = explore(problem.value, [n[1:] for n in nodes], best, visits)
        rows = [(list(c), at, bound, None) for c, at, bound in still]
        if found != best:
            rows.append((list(found[1]), None, None, found[0]))
        yield pd.DataFrame(rows, columns=["chosen", "at", "bound", "value"]).astype({"at": "Int32", "bound": "Float64", "value": "Float64"})

    return search


def best_choice(spark, problem: Problem, *, visits: int = VISITS) -> Choice:
    """An optimum: of equal totals the first in order. Rounds of tasks over the open nodes until none is left."""
    kind = "chosen array<int>, at int, bound double, value double"
    best = greedy(problem.scores, problem.blocked, problem.budget)
    shared = spark.sparkContext.broadcast(problem)
    first = [([k], k + 1, float("inf")) for k in range(len(problem.scores))]
    nodes, left, old = spark.createDataFrame(first, "chosen array<int>, at int, bound double"), len(first), None
    for k in range(len(problem.scores)):
        if _wins(float(problem.scores[k]), (k,), best):
            best = float(problem.scores[k]), (k,)
    while left:
        tasks = min(left, 4 * spark.sparkContext.defaultParallelism)
        done = written(nodes.repartition(tasks).mapInPandas(_round(shared, best, visits), kind), "nodes")
        for r in done.where("value is not null").select("value", "chosen").collect():  # one of a task at most
            if _wins(r["value"], tuple(r["chosen"]), best):
                best = r["value"], tuple(r["chosen"])
        if old is not None:
            forget(old)
        old = done
        nodes = done.where(F.col("value").isNull() & (F.col("bound") >= best[0] - SAME)).select("chosen", "at", "bound")
        left = nodes.count()
    if old is not None:
        forget(old)
    shared.destroy()
    return best


def select_sites(scored: DataFrame, grid: Grid, *, budget: int, min_distance_m: float, visits: int = VISITS) -> DataFrame:
    """cell_id, center_lon, center_lat, facility_type, best_score, optimal of the chosen cells.

    ``scored`` needs row, col and the columns named. Only cells that add to the
    total are chosen; of equally good sets, the one whose cells come first by
    score, then id. Null scores are never chosen. ``optimal`` is always true.
    """
    spark = scored.sparkSession
    size = (budget - 1) * (most_conflicts(grid, min_distance_m) + 1) + 1
    order = [F.desc("best_score"), F.col("cell_id")]
    kernel = written(scored.where("best_score > 0").orderBy(*order).limit(size).select("cell_id", "row", "col", "center_lon", "center_lat", "facility_type", "best_score"), "kernel")
    top = kernel.orderBy(*order).collect()  # at most ``size`` rows
    pairs = conflict_pairs(kernel, grid, min_distance_m).collect() if top else []  # at most size x most_conflicts rows
    forget(kernel)
    place = {r["cell_id"]: i for i, r in enumerate(top)}
    near: list[list[int]] = [[] for _ in top]
    for r in pairs:
        a, b = place[r["cell_a"]], place[r["cell_b"]]
        near[a].append(b)
        near[b].append(a)
    problem = pose(np.array([r["best_score"] for r in top], float), [np.array(sorted(x), int) for x in near], budget)
    chosen = best_choice(spark, problem, visits=visits)[1] if top else ()
    picked = spark.createDataFrame([top[k] for k in sorted(chosen)], kernel.schema)
    return picked.select("cell_id", "center_lon", "center_lat", "facility_type", "best_score", F.lit(True).alias("optimal"))
