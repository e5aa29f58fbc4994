"""Circulant MinHash near-duplicate detection.

Two permutations of the 32-bit universe are enough: the first scatters a text's
shingles, the second, shifted circularly by k, gives coordinate k of the
signature. Bands of coordinates make candidates and every link is confirmed on
the full shingle sets.

Equal sets are one class from the start. In each bucket all classes are first
held against the bucket's smallest id; links so found join most of a group
without a row for each pair. A bucket that still holds several components is
then compared whole, in blocks of bounded size with a row for each pair of
blocks, so no link between candidates is lost however large the bucket is.

Defined cases
* null, empty or word-less text: an empty set, linked with nothing.
* a text of fewer words than a shingle has: the whole sequence is its one shingle.
* rows of one id are one document, linked as any of its texts is; each row gets a result row.
* null id: its rows are linked with nothing; component null, kept.
* very long texts are hashed in bounded pieces; their sets are whole.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import SPACES, documents, forget, hashed_texts, mix64, stored

SHINGLE = 3
#: Per cent of the union that the intersection must reach.
SIMILAR = 85
#: A pair at the threshold shares no band with a probability of (1 - 0.85^4)^25 = 1e-8.
BANDS, ROWS = 25, 4
#: At most so many classes of equal texts are broadcast.
LARGE = 10_000
#: Shingles in a block of a bucket that is compared whole; 4 MB.
BLOCK_SHINGLES = 500_000


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the unsigned 32-bit integers."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(16)
    return x


def _turned(scattered: np.ndarray, shift: int) -> np.ndarray:
    """The second permutation, turned by ``shift`` places."""
    x = scattered + np.uint32(shift)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(14)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle."""
    odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1) for i in range(size)]
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        rolled += mix64(hashes[i : i + n] ^ odd[i]) * odd[i]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(rolled[at : at + c - size + 1]))
        elif c:
            part = hashes[at : at + c]
            out.append(mix64(np.array([int((mix64(part ^ np.array(odd[:c])) * np.array(odd[:c])).sum()) + c & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(texts, coordinates) circulant MinHash of non-empty sets."""
    scattered = _mix32((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_turned(scattered, k), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys; the band's number is part of the key."""
    keys = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + signature[:, b * rows + r])
        keys[:, b] = key
    return keys


def _signing(bands: int, rows: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, hashes, counts in hashed_texts(batch.column(1), SPACES):
                sets = shingle_sets(hashes, counts, size)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                digest = np.zeros((2, n), np.uint64)
                keys: list = [None] * n
                if len(full):
                    own = [sets[i] for i in full]
                    flat = np.concatenate(own)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        digest[k, full] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), starts)
                    for i, k in zip(full, band_keys(signatures(own, bands * rows), bands, rows).view(np.int64), strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "_a", "_b", "_keys"],
                )

    return sign


def _setting(size: int):
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, hashes, counts in hashed_texts(batch.column(1), SPACES):
                sets = [s.tobytes() for s in shingle_sets(hashes, counts, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(sets, pa.binary())], names=["id", "set"])

    return to_sets


def _confirming(similar: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= similar * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def block_links(sets: list[np.ndarray], roots: np.ndarray, similar: int, other: int | None = None, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked sets with different roots.

    other: pairs are taken only between the sets before and from that place;
    else among all. Intersections are counted by products of 0/1 matrices over
    the shingles that occur twice or more, a tile at a time.
    """
    sizes = np.array([len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = n[column] > 1
    number = np.cumsum(n > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(roots, kind="stable") if other is None else np.concatenate([o[np.argsort(roots[o], kind="stable")] for o in (np.arange(other), np.arange(other, len(sets)))])
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(sets))
    row = place[row]
    by_row = np.argsort(row, kind="stable")
    row, column = row[by_row], column[by_row]
    starts = np.searchsorted(row, np.arange(0, len(sets) + tile, tile))
    roots, sizes = roots[order], sizes[order]
    found: list[np.ndarray] = []

    def dense(t: int, columns: np.ndarray) -> np.ndarray:
        r, c = row[starts[t] : starts[t + 1]], column[starts[t] : starts[t + 1]]
        at = np.searchsorted(columns, c)
        ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == c)
        out = np.zeros((min(tile, len(sets) - t * tile), len(columns)), np.float32)
        out[r[ok] - t * tile, at[ok]] = 1
        return out

    tiles = -(-len(sets) // tile)
    for i in range(tiles):
        for j in range(i, tiles):
            a, b = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
            one_sided = other is not None and (a.start >= other or min(b.stop, len(sets)) <= other)
            if one_sided or roots[a].min() == roots[a].max() == roots[b].min() == roots[b].max():
                continue
            columns = np.intersect1d(column[starts[i] : starts[i + 1]], column[starts[j] : starts[j + 1]])
            both = np.zeros((len(roots[a]), len(roots[b])), np.float32)
            for at in range(0, len(columns), 4096):
                part = columns[at : at + 4096]
                x = dense(i, part)
                both += x @ (x if i == j else dense(j, part)).T
            hit = (100 * both >= similar * (sizes[a][:, None] + sizes[b][None] - both)) & (roots[a][:, None] != roots[b][None])
            x, y = np.nonzero(hit)
            x, y = x + a.start, y + b.start
            ok = x < y if other is None else (x < other) & (y >= other)
            found.append(np.stack([order[x[ok]], order[y[ok]]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(found, axis=1))


def _blocking(similar: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = [c[k].values for c in batch.columns if c[k].is_valid]
                ids, roots = (np.concatenate([m.field(f).to_numpy() for m in members]) for f in ("id", "root"))
                sets = [np.frombuffer(x.as_py(), np.uint64) for m in members for x in m.field("set")]
                i, j = block_links(sets, roots, similar, other=len(members[0]) if len(members) > 1 else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["u", "v"])

    return link


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked node reaches, by alternating large and small stars."""
    edges = stored(links.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(done)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if state == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        before = state


def _first_links(postings: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Confirmed links between each bucket's smallest id and its other members."""
    pivots = postings.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = postings.join(pivots, "key").where("id <> p.id").where(100 * F.least("n", "p.n") >= similar * F.greatest("n", "p.n"))
    pairs = pairs.select(F.col("p.id").alias("u"), F.col("id").alias("v")).distinct()
    members = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    full = members.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").select("u", "v", "a", "b")
    return full.mapInArrow(_confirming(similar), "u bigint, v bigint")


def _other_links(postings: DataFrame, sets: DataFrame, roots: DataFrame, similar: int, block: int) -> DataFrame:
    """Confirmed links between components within the buckets that hold several."""
    rooted = postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    stats = rooted.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("size"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("t"),
    )
    # Of two members the pair is known; buckets of the same members are compared once.
    mixed = stats.where("c > 2 and lo < hi").groupBy("c", "s", "t").agg(F.min("key").alias("key"), F.min("size").alias("size"))
    mixed = mixed.select("key", F.ceil(F.col("size") / block).alias("blocks"))
    member = F.struct("id", "root", "set").alias("m")
    blocks = (
        rooted.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
        .groupBy("key", "block", "blocks").agg(F.collect_list(member).alias("a"))
    )
    kind = blocks.schema["a"].dataType.simpleString()
    blocks = stored(blocks)
    inside = blocks.select("a", F.lit(None).cast(kind).alias("b"))
    left = blocks.where("blocks > 1").select("key", "block", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other > block")
    right = blocks.where("blocks > 1").select("key", F.col("block").alias("other"), F.col("a").alias("b"))
    across = left.join(right, ["key", "other"]).select("a", "b")
    found = stored(inside.unionByName(across).mapInArrow(_blocking(similar), "u bigint, v bigint"))
    forget(blocks)
    return found


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signing(bands, rows, shingle), "doc_id bigint, n_shingles bigint, _a bigint, _b bigint, _keys array<bigint>"))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        named.groupBy("_a", "_b").agg(F.min(F.struct("doc_id", "n_shingles", "_keys")).alias("c"), F.count(F.lit(1)).alias("m"))
        .select("_a", "_b", "m", F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("n"), F.col("c._keys").alias("_keys"))
    )
    postings = classes.select("id", "n", F.explode("_keys").alias("key"))
    crowded = postings.groupBy("key").count().where("count > 1").select("key")
    postings = stored(postings.join(crowded, "key").distinct())
    wanted = postings.select("id").distinct()
    sets = stored(
        texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_setting(shingle), "id bigint, set binary").where(F.length("set") > 0)
    )
    links = stored(_first_links(postings, sets, similar))
    more = _other_links(postings, sets, components(links), similar, block)
    # Texts of one id that are in several classes make those classes one.
    name = F.struct("_a", "_b")
    several = named.groupBy("doc_id").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").select("doc_id", "_a", "_b").distinct().join(classes.select("_a", "_b", "id"), ["_a", "_b"])
    again = same.select("doc_id", "id").join(same.groupBy("doc_id").agg(F.min("id").alias("least")), "doc_id").where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    roots = components(links.unionByName(more).unionByName(again))
    named_roots = stored(classes.select("_a", "_b", "m", "id").join(roots, "id", "left").select("_a", "_b", "m", F.coalesce("root", "id").alias("_root")))
    forget(classes, postings, sets, links, more)
    # Of the classes with over a ten-thousandth of the rows there are ten thousand at most: they are broadcast, so no task has all copies of a text.
    bound = signed.count() / LARGE
    large = F.broadcast(named_roots.where(F.col("m") > bound).drop("m"))
    rest = named.join(large, ["_a", "_b"], "left_anti").join(named_roots.where(F.col("m") <= bound).drop("m"), ["_a", "_b"])
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").withColumn("_root", F.col("doc_id"))
    placed = [x.select("doc_id", "n_shingles", F.col("_root").alias("component_id")) for x in (named.join(large, ["_a", "_b"]), rest, alone)]
    # A class's first row names it, also where its id has other texts in classes with smaller ids.
    return placed[0].unionByName(placed[1]).unionByName(placed[2]).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, one of each group of near duplicates; rows without an id stay.

    The row rides in one struct, so its columns may have any names.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stay = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    packed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # Rows of one id are one document.
    one = Window.partitionBy("_id").orderBy("_text")
    kept = packed.join(stay, "_id", "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth")
    whole = kept.unionByName(packed.where("_id is null"))
    return whole.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' '))) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {SIMILAR} * (x.n + y.n - k)
), reach AS (
  SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u
), m AS (
  SELECT u, min(v) AS lo FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, lo) AS component_id, doc_id = least(doc_id, lo) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = doc_id
"""
