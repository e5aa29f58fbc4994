"""Substring dedup by sliding sentence spans.

Sentences end at ``. ! ?`` or a line end; one of more than ``LONG`` words counts as
several, cut inside at words that come first, in the order of hashes, among those
near by, so that a passage within it has whole pieces of its own. From each sentence on, and
back from each, the shortest run of two or more with at least ``span_words`` words is hashed
(96 bits): whatever a longer repeated run covers, these cover. Runs are joined globally by their hash;
the sentences of a run that isn't the first of its hash, in order of id and place,
are removed. Runs are worked out once and written. Repeats within a text are found where the
text is read; only a text's first run of each hash crosses the network.

Defined cases
* null or word-less text: no spans. A text of fewer than ``span_words`` words has none either.
* null id: only repeats within the text itself are removed, as its place in the order isn't known.
* rows of one id are one document: what only they share stays; each row gets the spans of its own text.
* a passage that repeats within one document counts like one in two documents.
* words compare with A-Z lower-cased, white space and ASCII punctuation aside.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import CHUNK_BYTES, NON_WORD, documents, forget, hash_run, mix64, pieces, runs, stored

#: Words of a hashed run of sentences, at least.
SPAN_WORDS = 14
#: A sentence of more words is cut inside, after each word that comes first among so many on either side.
LONG, CLOSE = 24, 4

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_MARKS = _ENDS.copy()
_MARKS[ord("\n")] = False
#: Odd bases of the two polynomial hashes and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def sentence_bounds(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First words of the sentences, or pieces of long ones, and the number of words behind them. ends: whether a sentence ends after each word."""
    n = len(hashes)
    of = np.cumsum(np.concatenate([[0], ends[:-1]]))
    cut = np.bincount(of)[of] > LONG
    for d in range(1, CLOSE + 1):
        other = of[d:] != of[:-d]
        cut[d:] &= other | (hashes[d:] < hashes[:-d])
        cut[:-d] &= other | (hashes[:-d] <= hashes[d:])
    return np.concatenate([[0], np.flatnonzero((cut | ends)[:-1]) + 1, [n]])


def span_table(hashes: np.ndarray, ends: np.ndarray, span_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first word, end word, and the two hashes of each run, by place."""
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < span_words:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    bounds = sentence_bounds(hashes, ends)
    last = len(bounds) - 1
    at = np.arange(len(bounds))
    to = np.maximum(np.searchsorted(bounds, bounds + span_words), at + 2)
    back = np.minimum(np.searchsorted(bounds, bounds - span_words, "right") - 1, at - 2)
    runs_ = np.concatenate([np.stack([at, to], 1)[to <= last], np.stack([back, at], 1)[back >= 0]])
    code = np.unique(runs_[:, 0] * (last + 1) + runs_[:, 1])
    a, b = bounds[code // (last + 1)], bounds[code % (last + 1)]
    out = []
    for base, inverse in zip(_BASES, _INVERSES, strict=True):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(base)) * _powers(base, n - 1))])
        out.append(mix64((sums[b] - sums[a]) * _powers(inverse, n)[a] + (b - a).astype(np.uint64)))
    return a, b, *out


def _words(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: word hashes, whether a sentence ends after the word, and the words' character bounds, marks right behind a word included."""
    if len(cuts) == 2 and len(data) > CHUNK_BYTES:
        got, at = [], 0
        for p in pieces(data, NON_WORD):
            h, _, s, n = hash_run(p, np.array([0, len(p)]), NON_WORD)
            got.append((h, s + at, n))
            at += len(p)
        hashes, starts, lengths = (np.concatenate(x) for x in zip(*got, strict=True))
        counts = np.array([len(hashes)])
    else:
        hashes, counts, starts, lengths = hash_run(data, cuts, NON_WORD)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(_ENDS[data])])
    # The first byte from each place on that is no sentence mark.
    plain = np.append(np.where(_MARKS[data], len(data), np.arange(len(data))), len(data))
    plain = np.minimum.accumulate(plain[::-1])[::-1]
    at = 0
    for k, n in enumerate(counts):
        s, e = starts[at : at + n], starts[at : at + n] + lengths[at : at + n]
        after = np.append(s[1:], cuts[k + 1])[:n]
        yield hashes[at : at + n], marks[after] > marks[e], chars[s] - chars[cuts[k]], chars[np.minimum(plain[e], cuts[k + 1])] - chars[cuts[k]]
        at += n


def _spans(span_words: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for row, _, data, cuts in runs(batch.column(2)):
                found, source = [], []
                for k, (hashes, ends, starts, stops) in enumerate(_words(data, cuts)):
                    a, b, h, g = span_table(hashes, ends, span_words)
                    if len(a):
                        again = np.ones(len(a), bool)
                        again[np.unique(h ^ mix64(g), return_index=True)[1]] = False
                        found.append((h.view(np.int64), (g >> np.uint64(32)).astype(np.int64), starts[a], stops[b - 1] - starts[a], again))
                        source.append(np.full(len(a), row + k))
                if found:
                    h, g, first, size, again = (np.concatenate(x) for x in zip(*found, strict=True))
                    at = np.concatenate(source)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(g), batch.column(0).take(pa.array(at)), pa.array(keys[at]), pa.array(first), pa.array(size), pa.array(again)],
                        names=["_h", "_g", "_id", "_key", "_start", "_size", "_again"],
                    )

    return spans


def _text_key(text_col: str) -> Column:
    """Tells texts of one id, or of none, apart."""
    return F.xxhash64(text_col)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS) -> DataFrame:
    """(_id, _key, spans): the merged character ranges to remove from each document that has any."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), _text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(_spans(span_words), "_h bigint, _g bigint, _id bigint, _key bigint, _start bigint, _size bigint, _again boolean")
    # Start and size in one number: the row stays small.
    placed = stored(found.select("_h", "_g", "_id", "_key", (F.shiftleft("_start", 32) + F.col("_size")).alias("_range"), "_again"))
    once = placed.where("not _again and _id is not null").drop("_again")
    first = once.groupBy("_h", "_g").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    later = once.join(first, ["_h", "_g"]).where("_id > _first").select("_id", "_key", "_range")
    covered = later.unionByName(placed.where("_again").select("_id", "_key", "_range"))
    start = F.shiftright("_range", 32)
    span = F.struct(start.alias("start"), (start + F.col("_range").bitwiseAND(F.lit(0xFFFFFFFF))).alias("end"))
    ranges = covered.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(span)).alias("_ranges"))
    spans = stored(ranges.select("_id", "_key", merged(F.col("_ranges")).alias("spans")))
    forget(placed)
    return spans


def merged(ranges: Column) -> Column:
    """Sorted ranges with those that overlap or touch joined, keeping one open at the end of the list."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(state: Column, x: Column) -> Column:
        last = F.get(state["done"], F.size(state["done"]) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(state["done"], 1, F.size(state["done"]) - 1), F.array(wider))
        return F.struct(F.when((F.size(state["done"]) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(state["done"], F.array(x))).alias("done"))

    return F.aggregate(ranges, F.struct(F.array().cast(kind).alias("done")), add, lambda s: s["done"])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_chars, n_removed (characters), spans; with_text: also the text without them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), _text_key(text_col).alias("_key"), F.length(text).cast("bigint").alias("n_chars"),
        *([F.col(text_col).alias("text")] if with_text else []),
    )
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, span_words=span_words)
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["_key"] == spans["_key"]), "left").drop(spans["_id"], spans["_key"], rows["_key"])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = joined.withColumn("spans", F.coalesce("spans", none))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    columns = ["doc_id", "n_chars", removed.alias("n_removed"), "spans"]
    if with_text:
        gaps = F.transform(
            F.sequence(F.lit(0), F.size("spans")),
            lambda i: F.struct(
                F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)).alias("a"), F.coalesce(F.get("spans", i)["start"], F.col("n_chars")).alias("b")
            ),
        )
        kept = F.array_join(F.transform(gaps, lambda g: F.substring(F.col("text"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))), "")
        columns.append(F.when(F.size("spans") == 0, F.col("text")).otherwise(kept).alias("text"))
    return out.select(*columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
