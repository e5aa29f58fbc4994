"""Polygons laid over the grid, by clipping them down a quadtree of tiles.

A tile of level L has 2^L x 2^L cells. A polygon starts with the few tiles of its own size that its box
meets. Where a tile lies wholly inside it, the tile stands for all its cells and the ring is dropped; elsewhere the ring
is cut along the tile's middle lines and handed to the quarters it reaches, down to single cells. So a ring is cut
once a level, and the pieces grow with its outline, not with the cells of its box. Rings of all lengths are cut together, end to
end, in numpy. A task goes down to tiles of 2^SHARED cells a side; what is left of large polygons there is dealt out anew,
so that one large polygon occupies many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.geo import MERCATOR_M, mercator_x, mercator_y
from sitewise.operators.grid import Grid

#: Below tiles of this level a piece stays in its task.
SHARED = 5
#: Corners cut at once.
CORNERS = 1 << 20
#: Areas relative to a tile's, and metres, within which a piece is the tile or nothing.
SAME_AREA, SAME_PLACE = 1e-9, 1e-6
NO_AREA = 1e-13

PIECES = "population double, level int, row int, col int, amount double, density double, left int, xs array<double>, ys array<double>"


@dataclass
class Rings:
    """Rings end to end: corners, and the number of corners of each."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    def starts(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def take(self, rows: np.ndarray) -> Rings:
        n = self.n[rows]
        at = np.repeat(self.starts()[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rings(self.x[at], self.y[at], n)

    def after(self) -> np.ndarray:
        """The place of each corner's next one."""
        after = np.arange(len(self.x)) + 1
        own = self.n > 0
        after[self.starts()[own] + self.n[own] - 1] = self.starts()[own]
        return after

    def each(self, sums: np.ndarray) -> np.ndarray:
        """Sums of a value of each corner by ring."""
        total = np.concatenate([[0], np.cumsum(sums)])
        return total[self.starts() + self.n] - total[self.starts()]

    def extremes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and largest x, least and largest y; every ring has a corner."""
        at = self.starts()
        return np.minimum.reduceat(self.x, at), np.maximum.reduceat(self.x, at), np.minimum.reduceat(self.y, at), np.maximum.reduceat(self.y, at)

    def areas(self) -> np.ndarray:
        """Whatever way around; seen from a ring's own corner, so that large coordinates don't cancel."""
        if not len(self.x):
            return np.zeros(len(self.n))
        first = np.repeat(self.starts(), self.n)
        x, y, after = self.x - self.x[first], self.y - self.y[first], self.after()
        crossed = x * y[after] - x[after] * y
        own = self.n > 0
        sums = np.zeros(len(self.n))
        sums[own] = np.add.reduceat(crossed, self.starts()[own])
        return np.abs(sums) / 2

    def cut(self, behind: np.ndarray) -> Rings:
        """Without what lies before a line; behind: each corner's distance behind it."""
        after = self.after()
        far = behind[after]
        inside = behind >= 0
        crosses = inside != (far >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = behind / (behind - far)
            x, y = (np.stack([v, v + t * (v[after] - v)], axis=1) for v in (self.x, self.y))
        keep = np.stack([inside, crosses], axis=1)
        x, y = x[keep], y[keep]
        return Rings(x, y, self.each(keep.sum(axis=1)))


def _joined(rings: list[Rings]) -> Rings:
    return Rings(*(np.concatenate([getattr(r, c) for r in rings]) for c in ("x", "y", "n")))


@dataclass
class Pieces:
    """Clipped rings of one level: their polygon, tile and ring."""

    polygon: np.ndarray
    row: np.ndarray
    col: np.ndarray
    rings: Rings

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(self.polygon[rows], self.row[rows], self.col[rows], self.rings.take(rows))


class Edges:
    """The grid's lines in projected metres, from its south-west corner."""

    def __init__(self, grid: Grid) -> None:
        lons, lats = np.radians(grid.lon_edges), np.radians(grid.lat_edges)
        self.x, self.y = MERCATOR_M * lons, MERCATOR_M * np.log(np.tan(np.pi / 4 + lats / 2))
        self.origin = float(self.x[0]), float(self.y[0])
        self.x, self.y = self.x - self.x[0], self.y - self.y[0]
        self.rows, self.columns = grid.rows, grid.columns

    def sides(self, row: np.ndarray, col: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Left, right, low and high of tiles, within the grid."""
        return (
            self.x[np.minimum(col << level, self.columns)], self.x[np.minimum((col + 1) << level, self.columns)],
            self.y[np.minimum(row << level, self.rows)], self.y[np.minimum((row + 1) << level, self.rows)],
        )

    def reach(self, low: np.ndarray, high: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell between two places; the last is before the first if there is none."""
        first = np.maximum(np.searchsorted(edges, low, "right") - 1, 0)
        return first, np.minimum(np.searchsorted(edges, high, "left") - 1, len(edges) - 2)


def _first_pieces(rings: Rings, edges: Edges) -> dict[int, Pieces]:
    """Each polygon in the tiles, at most three a side, of the level that suits its box."""
    left, right, low, high = rings.extremes()
    r0, r1 = edges.reach(low, high, edges.y)
    c0, c1 = edges.reach(left, right, edges.x)
    span = np.maximum(r1 - r0, c1 - c0)
    found = {}
    levels = np.maximum(np.frexp(span)[1] - 1, 0)  # of a number's binary digits one less
    met = (r1 >= r0) & (c1 >= c0)
    for level in np.unique(levels[met]).tolist():
        own = np.flatnonzero(met & (levels == level))
        a, b, c, d = r0[own] >> level, r1[own] >> level, c0[own] >> level, c1[own] >> level
        wide = d - c + 1
        each = (b - a + 1) * wide
        at = np.repeat(np.arange(len(own)), each)
        k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        row, col = a[at] + k // wide[at], c[at] + k % wide[at]
        found[level] = Pieces(own[at], row, col, _in_tiles(rings.take(own[at]), edges.sides(row, col, level)))
    return found


def _in_tiles(rings: Rings, sides: tuple[np.ndarray, ...]) -> Rings:
    for axis, side, sign in (("x", 0, 1), ("x", 1, -1), ("y", 2, 1), ("y", 3, -1)):
        rings = rings.cut(sign * (getattr(rings, axis) - np.repeat(sides[side], rings.n)))
    return rings


def _quarters(pieces: Pieces, level: int, edges: Edges) -> Pieces:
    """The pieces cut along their tiles' middle lines."""
    made = []
    y = edges.y[np.minimum((2 * pieces.row + 1) << (level - 1), edges.rows)]
    x = edges.x[np.minimum((2 * pieces.col + 1) << (level - 1), edges.columns)]
    for up, sign in ((0, -1), (1, 1)):
        half = pieces.rings.cut(sign * (pieces.rings.y - np.repeat(y, pieces.rings.n)))
        for side, way in ((0, -1), (1, 1)):
            made.append(Pieces(pieces.polygon, 2 * pieces.row + up, 2 * pieces.col + side, half.cut(way * (half.x - np.repeat(x, half.n)))))
    whole = Pieces(*(np.concatenate([getattr(m, c) for m in made]) for c in ("polygon", "row", "col")), _joined([m.rings for m in made]))
    return whole.take(np.flatnonzero(whole.rings.n > 2))


def descend(start: dict[int, Pieces], edges: Edges, last: int) -> Iterator[tuple[int, Pieces, np.ndarray, bool]]:
    """(level, pieces, areas, whole): tiles wholly inside their polygon, single cells with the area inside, and what is left at level ``last``."""
    held = None
    for level in range(max(start, default=-1), -1, -1):
        ready = [p for p in (held, start.get(level)) if p is not None and len(p.row)]
        held = None
        if not ready:
            continue
        pieces = Pieces(*(np.concatenate([getattr(p, c) for p in ready]) for c in ("polygon", "row", "col")), _joined([p.rings for p in ready]))
        left, right, low, high = edges.sides(pieces.row, pieces.col, level)
        tile, areas = (right - left) * (high - low), pieces.rings.areas()
        some = (tile > 0) & (areas > NO_AREA * tile)
        x, y = pieces.rings.x, pieces.rings.y
        n = pieces.rings.n
        border = np.minimum(np.abs(x - np.repeat(left, n)), np.abs(x - np.repeat(right, n)))
        border = np.minimum(border, np.minimum(np.abs(y - np.repeat(low, n)), np.abs(y - np.repeat(high, n))))
        whole = some & (areas >= tile * (1 - SAME_AREA)) & (pieces.rings.each(border > SAME_PLACE) == 0)
        if level and whole.any():
            rows = np.flatnonzero(whole)
            yield level, pieces.take(rows), areas[rows], True
        rows = np.flatnonzero(some & ~whole if level else some)
        if level == 0:
            yield 0, pieces.take(rows), areas[rows], False
        elif level == last:
            yield level, pieces.take(rows), areas[rows], False
        else:
            held = _quarters(pieces.take(rows), level, edges)


def _summed(level: int, pieces: Pieces, amount: np.ndarray, density: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(pieces.row.astype(np.int64) << 32 | pieces.col, return_inverse=True)
    return key >> 32, key & 0xFFFFFFFF, np.bincount(at, amount, len(key)), np.bincount(at, density, len(key))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _rows(population, level, row, col, amount, density, rings: Rings | None = None) -> pa.RecordBatch:
    """A batch of PIECES; rings stay to be cut further."""
    n = len(row)
    lists = [pa.nulls(n, pa.list_(pa.float64()))] * 2
    if rings is not None:
        ends = np.concatenate([[0], np.cumsum(rings.n)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (rings.x, rings.y)]
    columns = [
        pa.nulls(n, pa.float64()) if population is None else pa.array(population), pa.array(np.full(n, level, np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)),
        pa.array(amount, pa.float64()), pa.array(density, pa.float64()), pa.array(np.full(n, int(rings is not None), np.int32)), *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["population", "level", "row", "col", "amount", "density", "left", "xs", "ys"])


def _parts(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in runs of bounded corners."""
    run = np.cumsum(lengths) // CORNERS
    for k in np.unique(run).tolist():
        yield np.flatnonzero(run == k)


def _emitted(found, population: np.ndarray, area: np.ndarray, summed: bool) -> Iterator[pa.RecordBatch]:
    """amount: of people where summed, else the share of the polygon. density: the same for a square metre of a tile wholly inside; the polygon's area beside a ring."""
    for level, pieces, areas, whole in found:
        if not len(pieces.row):
            continue
        own = pieces.polygon
        weight = population[own] if summed else np.ones(len(own))
        if level and not whole:
            yield _rows(population[own], level, pieces.row, pieces.col, np.zeros(len(own)), area[own], pieces.rings)
            continue
        amount = np.zeros(len(own)) if whole else weight * (areas / area[own])
        density = weight / area[own] if whole else np.zeros(len(own))
        if summed:
            row, col, amount, density = _summed(level, pieces, amount, density)
            yield _rows(None, level, row, col, amount, density)
        else:
            yield _rows(population[own], level, pieces.row, pieces.col, amount, density)


def _starting(edges: Edges, summed: bool):
    """Polygons (population, ring) down to shared tiles, small ones to single cells."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for rows in _parts(lengths):
                own = batch.slice(int(rows[0]), len(rows))
                corners = own.column(1).flatten()
                rings = Rings(*(corners.field(c).to_numpy(zero_copy_only=False) - o for c, o in zip((0, 1), edges.origin, strict=True)), lengths[rows].astype(np.int64))
                area = rings.areas()
                sized = np.flatnonzero((rings.n > 2) & (area > 0))
                rings, area, population = rings.take(sized), area[sized], own.column(0).to_numpy()[sized]
                if not len(sized):
                    continue
                first = _first_pieces(rings, edges)
                small = {k: p for k, p in first.items() if k < SHARED}
                large = {k: p for k, p in first.items() if k >= SHARED}
                yield from _emitted(descend(small, edges, -1), population, area, summed)
                yield from _emitted(descend(large, edges, SHARED), population, area, summed)

    return start


def _going_on(edges: Edges, summed: bool):
    """What is left of large polygons down to single cells; other pieces pass."""

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(6).to_numpy() == 1
            if not left.any():
                yield batch
                continue
            yield batch.filter(pa.array(~left))
            rest = batch.filter(pa.array(left))
            lengths = rest.column(7).value_lengths().to_numpy().astype(np.int64)
            for rows in _parts(lengths):
                own = rest.slice(int(rows[0]), len(rows))
                population, row, col, area = (own.column(c).to_numpy() for c in (0, 2, 3, 5))
                pieces = Pieces(np.arange(len(rows)), row.astype(np.int64), col.astype(np.int64), Rings(_flat(own.column(7)), _flat(own.column(8)), lengths[rows]))
                yield from _emitted(descend({SHARED - 1: _quarters(pieces, SHARED, edges)}, edges, -1), population, area, summed)

    return go_on


def pieces(polygons: DataFrame, grid: Grid, *, summed: bool) -> DataFrame:
    """PIECES of projected polygons (population, ring); ``summed``: added up by tile within a batch. The input is read once."""
    edges = Edges(grid)
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = polygons.where("population is not null and size(ring) > 2").select("population", "ring").repartition(tasks)
    started = dealt.mapInArrow(_starting(edges, summed), PIECES)
    return started.repartition(tasks).mapInArrow(_going_on(edges, summed), PIECES)


def by_cell(found: DataFrame, grid: Grid) -> DataFrame:
    """The pieces with tiles wholly inside spread over their cells: amount by row and column."""
    side = F.expr("shiftleft(1, level)")

    def cells(at: str, most: int):
        first = F.col(at) * side
        return F.sequence(first, F.least(first + side, F.lit(most)) - 1)

    spread = found.withColumn("_r", F.explode(cells("row", grid.rows))).withColumn("_c", F.explode(cells("col", grid.columns)))
    edged = grid.with_edges(spread)
    x0, x1, y0, y1 = F.get("_lons", F.col("_c")), F.get("_lons", F.col("_c") + 1), F.get("_lats", F.col("_r")), F.get("_lats", F.col("_r") + 1)
    area = (mercator_x(x1) - mercator_x(x0)) * (mercator_y(y1) - mercator_y(y0))
    amount = F.col("amount") + F.when(F.col("density") > 0, F.col("density") * area).otherwise(0.0)
    return edged.select("population", F.col("_r").alias("row"), F.col("_c").alias("col"), amount.alias("amount"))


def overlay(polygons: DataFrame, grid: Grid) -> DataFrame:
    """row, col, population, share: the pieces of projected polygons by cell, each with its share of the polygon's area.

    A cell of degrees is an upright rectangle in the projection too. Polygons without area and null populations give no piece.
    """
    return by_cell(pieces(polygons, grid, summed=False), grid).select("row", "col", "population", F.col("amount").alias("share"))


def population_sums(polygons: DataFrame, grid: Grid) -> DataFrame:
    """row, col, people: the sums of the polygons' shares. Tiles are added up before they are spread over cells."""
    tiles = pieces(polygons, grid, summed=True).groupBy("level", "row", "col").agg(F.sum("amount").alias("amount"), F.sum("density").alias("density"))
    return by_cell(tiles.withColumn("population", F.lit(None).cast("double")), grid).groupBy("row", "col").agg(F.sum("amount").alias("people"))
