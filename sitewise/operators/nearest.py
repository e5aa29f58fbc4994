"""The nearest of points that fit into a broadcast: a k-d tree in arrays, searched for whole batches at once.

Points are places on the unit sphere, where the straight distance has the order of the distance over ground. The tree is
complete: node k has the children 2k + 1 and 2k + 2, and its points lie together in one array, so it needs no pointers. Each
node has the box of its points. A batch first follows the splits to one leaf each, which bounds its distances, and then goes
down level by level with the pairs of query and node whose box is nearer than the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a leaf at most, pairs of query and node handled at once.
LEAF, PAIRS = 16, 1 << 18
#: Points of a tree: some 40 MB with their boxes.
MOST_POINTS = 1_000_000


def on_sphere(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


@dataclass(frozen=True)
class Tree:
    """lon, lat and places of the points in the order of the leaves; the bounds of each node's points, its box, and how it is split."""

    lon: np.ndarray
    lat: np.ndarray
    places: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: np.ndarray
    split: np.ndarray
    levels: int

    @staticmethod
    def of(lon: np.ndarray, lat: np.ndarray) -> Tree:
        """A tree of at least one point."""
        places = on_sphere(lon, lat)
        n = len(lon)
        levels = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        nodes = 2 ** (levels + 1) - 1
        begin, end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        low, high = np.zeros((nodes, 3)), np.zeros((nodes, 3))
        axis, split = np.zeros(nodes, np.int64), np.zeros(nodes)
        order = np.arange(n)
        end[0] = n
        for level in range(levels + 1):
            own = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            low[own] = np.minimum.reduceat(places[order], begin[own], axis=0)
            high[own] = np.maximum.reduceat(places[order], begin[own], axis=0)
            if level == levels:
                break
            axis[own] = (high[own] - low[own]).argmax(axis=1)
            # All nodes of the level are sorted at once along their widest sides.
            node = np.repeat(np.arange(len(own)), end[own] - begin[own])
            order = order[np.lexsort((places[order, axis[own][node]], node))]
            middle = (begin[own] + end[own]) // 2
            split[own] = places[order[middle], axis[own]]
            begin[2 * own + 1], end[2 * own + 1] = begin[own], middle
            begin[2 * own + 2], end[2 * own + 2] = middle, end[own]
        return Tree(lon[order], lat[order], places[order], begin, end, low, high, axis, split, levels)

    def _measured(self, asked: np.ndarray, query: np.ndarray, leaf: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Holds queries against the points of leaves; best: squared distances, found: places in the order of the leaves."""
        sizes = self.end[leaf] - self.begin[leaf]
        at = np.repeat(self.begin[leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        of = np.repeat(query, sizes)
        far = ((asked[of] - self.places[at]) ** 2).sum(axis=1)
        order = np.lexsort((at, far, of))
        first = order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))]
        nearer = first[far[first] < best[of[first]]]
        best[of[nearer]], found[of[nearer]] = far[nearer], at[nearer]

    def nearest(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The place of each query's nearest point."""
        asked = on_sphere(lon, lat)
        n = len(asked)
        best, found = np.full(n, np.inf), np.zeros(n, np.int64)
        if not n:
            return found
        node, every = np.zeros(n, np.int64), np.arange(n)
        for _ in range(self.levels):
            node = 2 * node + 1 + (asked[every, self.axis[node]] >= self.split[node])
        self._measured(asked, every, node, best, found)
        waiting = [(0, every, np.zeros(n, np.int64))]
        while waiting:
            level, query, node = waiting.pop()
            for at in range(PAIRS, len(query), PAIRS):
                waiting.append((level, query[at : at + PAIRS], node[at : at + PAIRS]))
            query, node = query[:PAIRS], node[:PAIRS]
            gap = np.maximum(np.maximum(self.low[node] - asked[query], asked[query] - self.high[node]), 0)
            near = (gap**2).sum(axis=1) < best[query]
            query, node = query[near], node[near]
            if not len(query):
                continue
            if level == self.levels:
                self._measured(asked, query, node, best, found)
            else:
                waiting.append((level + 1, np.concatenate([query, query]), np.concatenate([2 * node + 1, 2 * node + 2])))
        return found


def small_tree(points: DataFrame, most: int = MOST_POINTS) -> Tree | None:
    """The tree of (lon, lat) if these are at least one and at most ``most`` different points, which then are all that is read into the driver."""
    table = points.select("lon", "lat").distinct().limit(most + 1).toArrow()
    if not 0 < table.num_rows <= most:
        return None
    return Tree.of(*(table.column(c).to_numpy() for c in ("lon", "lat")))


def with_nearest(queries: DataFrame, tree: Tree, *, lon: str, lat: str) -> DataFrame:
    """The queries with ``_lon`` and ``_lat`` of their nearest point, found in batches; queries without a place have nulls."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            placed = ~(np.isnan(x) | np.isnan(y))
            at = np.zeros(len(batch), np.int64)
            at[placed] = own.nearest(x[placed], y[placed])
            found = [pa.array(v[at], mask=~placed) for v in (own.lon, own.lat)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["_row", "_lon", "_lat"])

    asked = queries.select(F.struct(*queries.columns).alias("_row"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    kind = T.StructType([asked.schema["_row"], T.StructField("_lon", T.DoubleType()), T.StructField("_lat", T.DoubleType())])
    return asked.mapInArrow(search, kind).select("_row.*", "_lon", "_lat")
