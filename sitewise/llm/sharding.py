"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shard bytes stay near equal.

A partial partition is eight sums with the groups behind them. Differencing
takes the two with the largest spread and adds one's largest sum to the other's
smallest, and so on in opposite order. Executors difference the groups of one
block each; the blocks' partial partitions, eight sums a block, are then
differenced the same way, level over level, so no task holds more than a block.

Defined cases
* null text: size 1, CRC of the empty text; the null texts are one group, apart from the empty text.
* null ids are placed like any other row; repeated rows are one group (their texts are equal).
* equal sizes are ordered by the text's digest, so results don't depend on the order of rows.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import documents, stored

#: Groups that one task differences, and partial partitions that one task combines.
BLOCK_ROWS = 8192
#: Rows of a shard that are numbered together, about; parts in all up to which their counts are broadcast.
SLOT_ROWS, BROADCAST_PARTS = 20_000, 100_000
#: At most so many groups of equal texts are broadcast.
LARGE = 10_000


def differenced(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    sums: (m, k), the sums of each partial partition. Returns (m, k): the final
    place of each of their parts. The spread of what is combined sets the order.
    """
    m, k = sums.shape
    place = np.argsort(-sums, axis=1, kind="stable")
    #: Of each node: its parts' sums in descending order, and the two nodes it came from.
    ordered = np.take_along_axis(sums, place, axis=1)
    heap = [(int(s[-1] - s[0]), i, s.tolist()) for i, s in enumerate(ordered)]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int], list[int]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        y = y[::-1]
        joined = [p + q for p, q in zip(x, y, strict=True)]
        order = sorted(range(k), key=joined.__getitem__, reverse=True)
        joined = [joined[i] for i in order]
        node = m + len(made)
        made.append((a, b, order, [k - 1 - i for i in order]))
        heapq.heappush(heap, (joined[-1] - joined[0], node, joined))
    # From the root down: where each node's descending parts end.
    ends: list = [None] * (m + len(made))
    ends[-1] = list(range(k))
    for j in range(len(made) - 1, -1, -1):
        a, b, of_a, of_b = made[j]
        end = ends[m + j]
        ends[a], ends[b] = [0] * k, [0] * k
        for i in range(k):
            ends[a][of_a[i]] = end[i]
            ends[b][of_b[i]] = end[i]
    out = np.empty((m, k), np.int64)
    np.put_along_axis(out, place, np.array(ends[:m]), axis=1)
    return out


def _spread_single(sizes: np.ndarray, k: int) -> np.ndarray:
    """The place of each single group."""
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    return differenced(sums)[:, 0]


def _blocks(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def kk_labels(groups: DataFrame, key: str, size: str, shards: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, shard) of each group, a row a group."""
    n = groups.count()
    blocks = _blocks(n, block_rows)
    # Dealing by the digest gives each block a fair sample of all sizes.
    block = F.pmod(F.xxhash64(key), F.lit(blocks))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([size, key], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({key: frame[key], size: frame[size], "_block": frame["_block"], "_part": _spread_single(frame[size].to_numpy(), shards)})

    kind = groups.schema[key].dataType.simpleString()
    placed = stored(
        groups.select(key, size, block.alias("_block")).groupBy("_block").applyInPandas(local, f"{key} {kind}, {size} bigint, _block bigint, _part bigint")
    )
    nodes = placed.groupBy("_block", "_part").agg(F.sum(size).alias("_sum"))

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="_block", columns="_part", values="_sum").reindex(columns=range(shards)).fillna(0).astype("int64")
        table = table.sort_index()
        ends = differenced(table.to_numpy())
        up = int(frame["_up"].iloc[0])
        return pd.DataFrame({"_up": up, "_block": np.repeat(table.index.to_numpy(), shards), "_part": np.tile(np.arange(shards), len(table)), "_end": ends.ravel(), "_sum": table.to_numpy().ravel()})

    if blocks == 1:
        return placed.select(key, F.col("_part").cast("int").alias("shard"))
    # Level over level: at most block_rows / shards partial partitions meet in a task.
    fan = max(2, block_rows // shards)
    maps: list[DataFrame] = []
    while blocks > 1:
        up = _blocks(blocks, fan)
        level = stored(
            nodes.withColumn("_up", F.pmod(F.col("_block"), F.lit(up))).groupBy("_up").applyInPandas(combine, "_up bigint, _block bigint, _part bigint, _end bigint, _sum bigint")
        )
        maps.append(level.select("_block", "_part", "_up", "_end"))
        nodes = level.groupBy(F.col("_up").alias("_block"), F.col("_end").alias("_part")).agg(F.sum("_sum").alias("_sum"))
        blocks = up
    for level in maps:
        placed = placed.join(level, ["_block", "_part"]).select(key, size, F.col("_up").alias("_block"), F.col("_end").alias("_part"))
    return placed.select(key, F.col("_part").cast("int").alias("shard"))


def with_slots(rows: DataFrame, shard: str, order: list[Column], *, shards: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard.

    A shard's rows are numbered in parts of about ``slot_rows`` rows, each from the count of
    those before it; the table of counts has a row a part.
    """
    rows = stored(rows)
    parts = max(1, -(-rows.count() // (slot_rows * shards)))
    rows = rows.withColumn("_slot_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy(shard, "_slot_part").count()
    before = Window.partitionBy(shard).orderBy("_slot_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_slot_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_slot_part").orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(within))
    joined = numbered.join(F.broadcast(offsets) if parts * shards <= BROADCAST_PARTS else offsets, [shard, "_slot_part"])
    return joined.withColumn("slot", (F.col("_before") + F.col("_n") - 1).cast("bigint")).drop("_before", "_n", "_slot_part")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col)
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("")).alias("_key"),
    )
    groups = stored(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n")))
    labels = kk_labels(groups.drop("_n"), "_key", "_bytes", shards, block_rows=block_rows)
    # Groups with over a ten-thousandth of the rows are ten thousand at most: broadcast, so no task has all rows of one.
    often = groups.where(F.col("_n") > (groups.agg(F.sum("_n")).first()[0] or 0) / LARGE).select("_key")
    large = F.broadcast(labels.join(F.broadcast(often), "_key", "left_semi"))
    placed = rows.join(large, "_key").unionByName(rows.join(large, "_key", "left_anti").join(labels, "_key")).drop("_key")
    slotted = with_slots(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards=shards)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
