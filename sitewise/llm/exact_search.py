"""Exact top-k by inner product: a uniform threshold over the score lists of groups of dimensions, in three phases.

A vector's dimensions fall into groups, and each group has a score list for every query: the candidates by their part of the
inner product. Candidates are spread over tasks; a task holds all groups of its own.
1. Gather: each task takes the best k of each of its lists, works out their whole scores and sends a query's best k of these.
2. Cutoff: the k-th of all scores sent is one that k candidates reach, so a result scores no less, and with m lists is at
   least an m-th of it in some list. This safe cutoff of each query is broadcast, and tasks collect every
   entry of a list that reaches it: nothing else can be a result.
3. Resolve: what the other lists add to a collected entry is added up exactly, and those that reach the whole
   score go to the final order; of a task at most k for a query, so ties and copies aren't multiplied.

Components are whole numbers. Sums below 2^53 are worked out in doubles, which hold them exactly, larger ones in longs.
Queries are packed into blocks of bounded bytes, and a pass over the candidates takes a bounded number of blocks: what is
broadcast is bounded whatever the number of queries, and each block meets all candidates in tiles of bounded size.

Defined cases
* a vector that is null, empty or has a null or non-finite component takes no part, nor does a row without an id.
* vectors of different lengths have no inner product: a query's candidates are those of its own length.
* rows of the query's own id are its own. Repeated queries have results each, repeated candidates are candidates each.
* ties go to the smaller id. Fewer candidates than k: all. An empty table: no row.
* scores that no long holds are an error.
* other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import forget, shared_folder, stored

# The scale of components, and the queries' divisor.
SCALE, QUERY_EVERY = 1024, 100
#: Results of a query.
BEST = 10
#: Groups of dimensions. Two let the fewest entries pass: a larger number has a lower cutoff for each list.
LISTS = 2
#: Queries and bytes of a block at most, and blocks of a pass: a pass broadcasts at most 32 MB.
BLOCK_QUERIES, BLOCK_BYTES, PASS_BLOCKS = 512, 1 << 20, 32
#: Candidates that meet a block at once.
TILE = 1024
#: No score: below every other.
NONE = np.iinfo(np.int64).min


def whole_vector(vector: Column, scale: int) -> Column:
    """The vector in whole numbers; null where it takes no part."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when((F.size(vector) > 0) & fine, F.transform(wide, lambda c: F.floor(scale * c)))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch's vectors of each length."""
    ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
    values, ends = batch.column(1).flatten().to_numpy(), np.cumsum(lengths)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], values[(ends[rows] - d)[:, None] + np.arange(d)]


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(d: int) -> pa.RecordBatch:
        ids, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
        columns = [pa.array([d]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["d", "ids", "vectors"])

    for batch in batches:
        for ids, x in _by_length(batch):
            d = x.shape[1]
            rows = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * d)))
            while len(ids):
                room = rows - sum(len(i) for i, _ in held.get(d, []))
                held.setdefault(d, []).append((ids[:room], x[:room]))
                ids, x = ids[room:], x[room:]
                if sum(len(i) for i, _ in held[d]) == rows:
                    yield block(d)
    for d in list(held):
        yield block(d)


class Best:
    """The best k (score, id, total) of each query so far; of equal scores the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.rows = k, tuple(np.empty(0, np.int64) for _ in range(4))
        self.floor = np.full(queries, NONE)  # what a query's k-th has

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, total: np.ndarray) -> None:
        query, score, ids, total = (np.concatenate(c) for c in zip(self.rows, (query, score, ids, total), strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        starts = np.searchsorted(query, query)
        keep = np.arange(len(query)) - starts < self.k
        self.rows = query[keep], *(c[order][keep] for c in (score, ids, total))
        last = np.flatnonzero(np.arange(len(query)) - starts == self.k - 1)
        self.floor[query[last]] = score[order][last]


class Block:
    """A block of queries with its place in the pass."""

    def __init__(self, place: int, d: int, ids: bytes, vectors: bytes) -> None:
        self.place, self.d = place, d
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(-1, d)

    def groups(self, lists: int) -> list[slice]:
        edges = np.linspace(0, self.d, min(lists, self.d) + 1).astype(int).tolist()
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _largest(x: np.ndarray) -> int:
    """The largest absolute component, in whole numbers of any size."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _tiles(block: Block, ids: np.ndarray, x: np.ndarray, lists: int) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
    """(candidates, their part of the score in each list, which pairs are a query's own)."""
    bound = _largest(block.vectors) * _largest(x) * block.d
    if bound >= 2**63:
        raise OverflowError("a score that no long holds")
    kind = np.float64 if bound < 2**53 else np.int64
    queries = block.vectors.astype(kind)
    for at in range(0, len(ids), TILE):
        span = slice(at, at + TILE)
        tile = x[span].astype(kind)
        yield span, [tile[:, g] @ queries[:, g].T for g in block.groups(lists)], ids[span, None] == block.ids


def _gathering(blocks, k: int, lists: int):
    """Phase 1: (place, query, total) of the best k of each list, whole scores worked out, at most k a query."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_blocks = blocks.value
        tops = [[Best(len(b.ids), k) for _ in b.groups(lists)] for b in own_blocks]
        seen = 0
        for batch in batches:
            for ids, x in _by_length(batch):
                rows = np.arange(seen, seen + len(ids))  # numbers of this task's candidates: one may be in several lists
                seen += len(ids)
                for block, top in zip(own_blocks, tops, strict=True):
                    if block.d != x.shape[1]:
                        continue
                    for span, parts, own in _tiles(block, ids, x, lists):
                        tile = rows[span]
                        for best, part in zip(top, parts, strict=True):
                            least = best.floor
                            if len(tile) > k + 1 and least.min() == NONE:  # one more than k, as the query's own row may be among them
                                least = np.maximum(least, np.partition(part, len(tile) - k - 1, axis=0)[-k - 1])
                            at, q = np.nonzero((part >= least) & ~own)
                            if len(at):
                                total = sum(p[at, q] for p in parts)
                                best.offer(q, part[at, q].astype(np.int64), tile[at], total.astype(np.int64))
        for block, top in zip(own_blocks, tops, strict=True):
            query, row, total = (np.concatenate([b.rows[c] for b in top]) for c in (0, 2, 3))
            once = np.unique(np.stack([query, row, total]), axis=1)
            best = Best(len(block.ids), k)
            best.offer(once[0], once[2], once[1], once[2])
            n = len(best.rows[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.place)), pa.array(best.rows[0]), pa.array(best.rows[3])], names=["place", "query", "total"])

    return gather


def _resolving(blocks, cutoffs, k: int, lists: int):
    """Phases 2 and 3: (place, query, query_id, vec_id, score) of the entries that reach the cutoff, at most k a query."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_blocks, needed = blocks.value, cutoffs.value
        tops = [Best(len(b.ids), k) for b in own_blocks]
        for batch in batches:
            for ids, x in _by_length(batch):
                for block, best, need in zip(own_blocks, tops, needed, strict=True):
                    if block.d != x.shape[1]:
                        continue
                    for span, parts, own in _tiles(block, ids, x, lists):
                        # A whole number that is at least an m-th of the score is at least that share rounded up.
                        share = np.where(need == NONE, NONE, -(-need // len(parts)))
                        collected = parts[0] >= share
                        for part in parts[1:]:
                            collected |= part >= share
                        at, q = np.nonzero(collected & ~own)
                        total = sum(p[at, q] for p in parts).astype(np.int64)
                        enough = total >= np.maximum(need[q], best.floor[q])
                        if enough.any():
                            best.offer(q[enough], total[enough], ids[span][at[enough]], total[enough])
        for block, best in zip(own_blocks, tops, strict=True):
            query, score, ids, _ = best.rows
            columns = [pa.array(np.full(len(query), block.place)), pa.array(query), pa.array(block.ids[query]), pa.array(ids), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "query", "query_id", "vec_id", "score"])

    return resolve


def exact_top_k(
    candidates: DataFrame, queries: DataFrame, *, k: int = BEST, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, lists: int = LISTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best k candidates by inner product of the vectors in whole numbers."""
    spark = candidates.sparkSession

    def numbers(table: DataFrame) -> DataFrame:
        return table.select(F.col(id_col).cast("bigint").alias("vec_id"), whole_vector(F.col(vector_col), scale).alias("x")).where("vec_id is not null and x is not null")

    rows = stored(numbers(candidates))
    asked = numbers(queries)
    packed = stored(asked.repartition(max(1, -(-asked.count() // 8192))).mapInArrow(_packing, "d bigint, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id()))
    blocks = [r["block"] for r in packed.select("block").orderBy("block").collect()]  # a number for each block
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    kind = "place bigint, query bigint, query_id bigint, vec_id bigint, score bigint"
    found = None
    for at in range(0, len(blocks), PASS_BLOCKS):
        own = [Block(i, r["d"], r["ids"], r["vectors"]) for i, r in enumerate(packed.where(F.col("block").isin(blocks[at : at + PASS_BLOCKS])).collect())]
        shared = spark.sparkContext.broadcast(own)
        gathered = rows.mapInArrow(_gathering(shared, k, lists), "place bigint, query bigint, total bigint")
        kth = F.row_number().over(Window.partitionBy("place", "query").orderBy(F.desc("total")))
        cut = gathered.withColumn("rank", kth).where(F.col("rank") == k).toPandas()  # a number a query of the pass
        needed = [np.full(len(b.ids), NONE) for b in own]
        for b, need in zip(own, needed, strict=True):
            mine = cut[cut["place"] == b.place]
            need[mine["query"].to_numpy(np.int64)] = mine["total"].to_numpy(np.int64)
        cutoffs = spark.sparkContext.broadcast(needed)
        entries = rows.mapInArrow(_resolving(shared, cutoffs, k, lists), kind)
        order = F.row_number().over(Window.partitionBy("place", "query").orderBy(F.desc("score"), F.col("vec_id")))
        found = entries.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(folder)
        shared.destroy()
        cutoffs.destroy()
    forget(rows, packed)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    return spark.createDataFrame([], schema) if found is None else spark.read.schema(schema).parquet(folder)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(table, table.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE_SQL = f"""
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM numbers q JOIN numbers c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {BEST}"""
