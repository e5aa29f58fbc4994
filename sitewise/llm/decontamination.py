"""Benchmark decontamination by an FM-index of each training shard.

A shard (rows of one Arrow batch, at most SHARD_WORDS words or one text) becomes a sequence of
word numbers; a word that no window has is a separator, as is the end of a text. Its
suffix array gives the Burrows-Wheeler transform, held as a wavelet matrix; all
benchmark windows are searched backwards at once through its ranks, occurrences
are located by walking to sampled suffix positions, and the words they cover
merge into removal spans.

The benchmark's items are hashed, dealt to blocks of about BLOCK_WORDS words and made into
windows by tasks. PASS_BLOCKS blocks are broadcast for a pass over the documents, in which each shard is indexed once, by
the words of all the pass's blocks, and searched for one block after another. So neither a task nor the driver holds more than a
fixed number of blocks. A benchmark of more blocks takes several passes: the documents are then written once, with a number for each row,
and a pass hands on no more than the numbers, hits and items of rows that have any.

Defined cases
* null or word-less text: no words, not contaminated. Null items or items without words have no window.
* null item id: its windows mark words, but no id is listed or counted for it.
* repeated items, and items of equal text, are each listed (by distinct id).
* null document ids and repeated rows: a result row for each row.
* an item shorter than ``window`` words is one window of its own length.
* an empty benchmark marks nothing; an empty table gives no rows; other columns are ignored.
* words are held as 64-bit hashes; see ``hashed_texts``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from sitewise.llm.common import NON_WORD, documents, forget, hash_run, hashed_texts, runs, stored

WINDOW = 10
#: Words of benchmark text in a block, about, and of an item's piece in it; windows take up to 40 bytes a word.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
#: Blocks searched in one pass over the documents.
PASS_BLOCKS = 4
#: Rows with hits up to so many are broadcast to the documents of the next pass.
BROADCAST_ROWS = 50_000
#: Words of a shard.
SHARD_WORDS = 500_000
#: Every so many places of a shard the suffix array is kept.
SAMPLE = 16


# ------------------------------------------------------------------ FM-index


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; each 0 is a separator, smaller than all else and ordered by place."""
    n = len(symbols)
    zero = symbols == 0
    zeros = int(zero.sum())
    order_of = np.unique(symbols[~zero], return_inverse=True)[1]
    rank = np.empty(n, np.int64)
    rank[zero] = np.arange(zeros)
    rank[~zero] = zeros + order_of
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step or None] = rank[step:] + 1 if step < n else 0
        # Nothing behind a separator counts.
        key = rank * (n + 1) + np.where(zero, 0, after)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            step = n


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols and places at once."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros_before: list[np.ndarray] = []
        level = sequence
        for bit in range(bits - 1, -1, -1):
            one = (level >> bit) & 1 == 1
            self.zeros_before.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            level = np.concatenate([level[~one], level[one]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        start, at = np.zeros(len(symbols), np.int64), places.astype(np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros_before, strict=True):
            one = (symbols >> bit) & 1 == 1
            zeros = int(before[-1])
            start = np.where(one, zeros + start - before[start], before[start])
            at = np.where(one, zeros + at - before[at], before[at])
        return at - start


class FMIndex:
    """Count and locate over a sequence of numbers; 0 separates and is never searched."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.last[order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.ranks = WaveletMatrix(self.last, max(1, int(alphabet - 1).bit_length()))
        # Sampled: every so many places, and each place behind a separator, so no walk crosses one.
        self.sampled = (order % sample == 0) | (self.last == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def _step(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.ranks.rank(symbols, places)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``patterns`` at once: bounds of their suffix intervals."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.last), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = np.flatnonzero((lengths >= back) & (low < high))
            symbols = patterns[alive, lengths[alive] - back]
            low[alive], high[alive] = self._step(symbols, low[alive]), self._step(symbols, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffix-array rows."""
        found, at, moved = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            own = open_[done]
            found[own] = self.samples[self.sample_rank[at[own]]] + moved[own]
            open_ = open_[~done]
            at[open_] = self._step(self.last[at[open_]], at[open_])
            moved[open_] += 1
        return found


# ----------------------------------------------------------------- benchmark


class Phrases:
    """A block of benchmark windows: sorted word hashes, distinct windows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.vocabulary = np.unique(np.concatenate([h for _, h in items]))
        owners: dict[bytes, set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, hashes) in enumerate(items):
            numbers = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1):
                owners.setdefault(numbers[at : at + size].tobytes(), set()).add(k)
        self.lengths = np.array([len(w) // 4 for w in owners])
        self.patterns = np.zeros((len(owners), window), np.int32)
        for row, w in enumerate(owners):
            self.patterns[row, : len(w) // 4] = np.frombuffer(w, np.int32)
        self.owner = np.concatenate([sorted(o) for o in owners.values()]).astype(np.int64)
        self.owner_from = np.concatenate([[0], np.cumsum([len(o) for o in owners.values()])])


class Search:
    """Blocks that are searched for in one pass: the words of all of them, and the windows of each in numbers of these words."""

    def __init__(self, blocks: list[bytes]) -> None:
        self.blocks: list[Phrases] = [pickle.loads(b) for b in blocks]
        self.vocabulary = np.unique(np.concatenate([p.vocabulary for p in self.blocks]))
        self.patterns = [np.append(0, np.searchsorted(self.vocabulary, p.vocabulary) + 1)[p.patterns] for p in self.blocks]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words outside."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _pieces(window: int, most: int):
    """(item, hashes): the items' words; a long item goes on in another row, from the first window that this one lacks."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = np.concatenate([h for *_, h, _ in hashed_texts(pa.array([text.as_py()]), NON_WORD)])
                parts = []
                while len(hashes) > most:
                    parts.append(hashes[:most].tobytes())
                    hashes = hashes[most - window + 1 :]
                if len(hashes):
                    parts.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["item", "hashes"])

    return cut


def phrase_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, phrases): the benchmark's windows in blocks of about ``block_words`` words, a row a block, stored."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(window, max(window, min(PIECE_WORDS, block_words))), "item string, hashes binary"))
    words = pieces.agg(F.sum(F.length("hashes"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "hashes"), F.lit(max(1, -(-words // (8 * block_words)))))

    def build(table: pa.Table) -> pa.Table:
        items = [(i, np.frombuffer(h, np.uint64)) for i, h in zip(table["item"].to_pylist(), table["hashes"].to_pylist(), strict=True)]
        return pa.table({"block": table["block"][:1], "phrases": pa.array([pickle.dumps(Phrases(items, window))], pa.binary())})

    blocks = stored(pieces.withColumn("block", block).groupBy("block").applyInArrow(build, "block bigint, phrases binary"))
    forget(pieces)
    return blocks


# -------------------------------------------------------------------- shards


def _shards(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word bounds of its rows) of shards of at most SHARD_WORDS words, or of one text."""
    first, hashes, counts = 0, [], []
    for row, _, h, n in hashed_texts(column, NON_WORD):
        if hashes and sum(map(len, hashes)) + len(h) > SHARD_WORDS:
            yield first, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            first, hashes, counts = row, [], []
        hashes.append(h)
        counts.append(n)
    if hashes:
        yield first, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _occurrences(hashes: np.ndarray, bounds: np.ndarray, search: Search) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """(block, first words, windows) of all occurrences of each block's windows in a shard."""
    numbers = search.numbers(hashes)
    # A separator before each text and at the end.
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    spot = np.arange(len(numbers)) + text + 1
    symbols = np.zeros(len(numbers) + len(bounds), np.int64)
    symbols[spot] = numbers
    index = FMIndex(symbols, len(search.vocabulary) + 1)
    for phrases, patterns in zip(search.blocks, search.patterns, strict=True):
        low, high = index.search(patterns, phrases.lengths)
        which = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
        if len(rows):
            yield phrases, np.searchsorted(spot, index.locate(rows)), which


def _search(column: pa.Array, search: Search | None) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str | None]]]:
    """Of each text: number of words, the ranges of hit words, apart and in order, and the items found."""
    counts = np.zeros(len(column), np.int64)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    found: list[set[str | None]] = [set() for _ in range(len(column))]
    for first, hashes, bounds in _shards(column):
        counts[first : first + len(bounds) - 1] = np.diff(bounds)
        if search is None or not len(hashes):
            continue
        edges = np.zeros(len(hashes) + 1, np.int64)
        for phrases, start, which in _occurrences(hashes, bounds, search):
            np.add.at(edges, start, 1)
            np.add.at(edges, start + phrases.lengths[which], -1)
            doc = np.searchsorted(bounds, start, "right") - 1
            for d, w in np.unique(np.stack([doc, which]), axis=1).T:
                found[first + d].update(phrases.items[i] for i in phrases.owner[phrases.owner_from[w] : phrases.owner_from[w + 1]])
        if not edges.any():
            continue
        # Hit words of neighbouring texts touch: a text's end ends a range too.
        hit = np.cumsum(edges[:-1]) > 0
        new = np.concatenate([[True], np.diff(hit.astype(np.int8)) != 0])
        new[bounds[1:-1][bounds[1:-1] < len(hit)]] = True
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(hit))
        for a, b in zip(begins[hit[begins]].tolist(), ends[hit[begins]].tolist(), strict=True):
            row = int(np.searchsorted(bounds, a, "right")) - 1
            ranges[first + row].append((a - int(bounds[row]), b - int(bounds[row])))
    return counts, ranges, found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _searched(batch: pa.RecordBatch, at: int, search: Search | None) -> tuple[pa.StructArray, np.ndarray, list, list]:
    """The rows, and with what earlier passes found: their words, hit ranges and items."""
    rows = batch.column(0)
    counts, ranges, found = _search(rows.field(at), search)
    for i in np.flatnonzero(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)):
        ranges[i] = _merged(ranges[i] + [(x["a"], x["b"]) for x in batch.column(1)[i].as_py()])
        found[i].update(batch.column(2)[i].as_py())
    return rows, counts, ranges, found


def _finding(blocks: Broadcast):
    """Of the numbered texts that have any: hits and items of a pass."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(blocks.value)
        for batch in batches:
            _, ranges, found = _search(batch.column(1), search)
            rows = [i for i, r in enumerate(ranges) if r]
            hits = pa.array([[{"a": a, "b": b} for a, b in ranges[i]] for i in rows], _HITS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), hits, pa.array([list(found[i]) for i in rows], pa.list_(pa.string()))], names=["no", "hits", "items"])

    return find


def _hit_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of ranges of words of one text."""
    data = next(runs(pa.array([text]), len(text) * 4 + 4))[2]
    _, _, starts, lengths = hash_run(data, np.array([0, len(data)]), NON_WORD)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[starts[b - 1] + lengths[b - 1]])) for a, b in ranges]


def _reporting(blocks: Broadcast | None, kind: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = blocks and Search(blocks.value)
        for batch in batches:
            rows, counts, ranges, found = _searched(batch, 1, search)
            n_hit = np.array([sum(b - a for a, b in r) for r in ranges], np.int64)
            ids = [sorted(i for i in f if i is not None) for f in found]
            texts = rows.field(1)
            spans = [[{"start": a, "end": b} for a, b in _hit_spans(texts[i].as_py(), r)] if r else [] for i, r in enumerate(ranges)]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            columns = [rows.field(0).cast(kind), pa.array(counts), pa.array(n_hit), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return report


def _removing(blocks: Broadcast | None, schema: pa.Schema, at: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = blocks and Search(blocks.value)
        for batch in batches:
            rows, counts, ranges, _ = _searched(batch, at, search)
            columns = rows.flatten()
            n_hit = np.array([sum(b - a for a, b in r) for r in ranges], np.int64)
            if n_hit.any():
                values = columns[at].to_pylist()
                for i in np.flatnonzero(n_hit):
                    text, out, last = values[i], [], 0
                    for a, b in _hit_spans(text, ranges[i]):
                        out.append(text[last:a])
                        last = b
                    values[i] = "\n".join([*out, text[last:]])
                columns[at] = pa.array(values, columns[at].type)
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            # A text that was all benchmark goes.
            yield whole.filter(pa.array((n_hit == 0) | (n_hit < counts)))

    return remove


def _passes(rows: DataFrame, blocks: DataFrame, at: int) -> tuple[DataFrame, Broadcast | None]:
    """(row, hits, items): the rows, a struct whose field ``at`` is the text, with what all passes but the last have found; and the last one's blocks."""
    context = rows.sparkSession.sparkContext
    kinds = {"hits": "array<struct<a: bigint, b: bigint>>", "items": "array<string>"}
    numbers = [r["block"] for r in blocks.select("block").orderBy("block").collect()]

    def broadcast(at: int) -> Broadcast:
        return context.broadcast([r["phrases"] for r in blocks.where(F.col("block").isin(numbers[at : at + PASS_BLOCKS])).orderBy("block").collect()])

    if len(numbers) <= PASS_BLOCKS:
        last = broadcast(0) if numbers else None
        forget(blocks)
        return rows.select("row", *[F.array().cast(k).alias(c) for c, k in kinds.items()]), last
    frozen = stored(rows.select("row", F.monotonically_increasing_id().alias("no")))
    text = F.col("row").getField(rows.schema["row"].dataType.names[at])
    found = []
    for k in range(0, len(numbers) - PASS_BLOCKS, PASS_BLOCKS):
        own = broadcast(k)
        found.append(stored(frozen.select("no", text.alias("text")).mapInArrow(_finding(own), f"no bigint, hits {kinds['hits']}, items {kinds['items']}")))
        own.destroy()
    last = broadcast(k + PASS_BLOCKS)
    forget(blocks)
    whole = reduce(DataFrame.unionByName, found).groupBy("no").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in kinds])
    hit = stored(whole)
    forget(*found)
    joined = frozen.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, "no", "left")
    return joined.select("row", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()]), last


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (characters to remove)."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).alias("row"))
    state, last = _passes(rows, phrase_blocks(benchmark, id_col=item_col, window=window, block_words=block_words), 1)
    return state.mapInArrow(
        _reporting(last, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start: bigint, end: bigint>>",
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all their columns, with hit words cut from the texts; those left without a word go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)
    state, last = _passes(rows, phrase_blocks(benchmark, id_col=item_col, window=window, block_words=block_words), at)
    return state.mapInArrow(_removing(last, to_arrow_schema(docs.schema), at), docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least({WINDOW}, len(ws)) AS n FROM b WHERE len(ws) > 0))
), dw AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM dw JOIN bw USING (n, k)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
