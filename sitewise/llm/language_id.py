"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count the n-grams of their rows by language and Spark sums the counts; the
log-probability matrix (learned languages x buckets) is broadcast, and texts are
scored in numpy as sparse rows times that matrix. Languages beyond ``MOST_LANGUAGES`` have matrices of
their own, held one after another: each scores the texts, and the best and the sum of all go on to the next.

Defined cases
* null text, or a text with no letter: ``und`` with score 0, held out or not.
* null language: not learned from. Null or empty texts teach nothing.
* null id: never held out; a result row with a null id. Repeated rows each count and each get a row.
* no row to learn from: every row is ``und`` with score 0.
* very long texts are counted and scored whole, a bounded piece at a time.
* other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitewise.llm.common import documents, forget, stored

#: Buckets that n-grams of one to three characters are hashed into.
BUCKETS = 1 << 15
#: A matrix has at most this many rows, so a broadcast is at most 25 MB.
MOST_LANGUAGES = 200
#: Characters handled at once.
PIECE = 1 << 19
SMOOTHING = 0.5


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_and_gaps(text: str) -> np.ndarray:
    """Lower-cased code points with each run of other characters as one space, padded by a space and two."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.where(is_letter, codes, np.uint32(0x20))[keep]
    return np.concatenate([np.array([0x20], np.uint32), codes, np.array([0x20, 0x20], np.uint32)])


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets (3, n - 2) of the one-, two- and three-grams that start at each place but the last two."""
    c = codes.astype(np.uint64)
    one = c[:-2] * np.uint64(0x9E3779B97F4A7C15)
    two = one + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + c[2:] * np.uint64(0x165667B19E3779F9)
    out = np.empty((3, len(c) - 2), np.int64)
    for row, (h, salt) in enumerate(((one, 1), (two, 2), (three, 3))):
        h = (h + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        out[row] = (h >> np.uint64(40)) & np.uint64(BUCKETS - 1)
    return out


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(codes) - 2, PIECE):
        yield codes[at : at + PIECE + 2]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if lang not in counts and len(counts) >= 64:
                yield from flushed()
            c = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            c[BUCKETS] += 1  # texts
            for piece in _pieces(letters_and_gaps(text.as_py())):
                c[:BUCKETS] += np.bincount(ngram_buckets(piece).ravel(), minlength=BUCKETS)
    yield from flushed()


def fit(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGUAGES) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Blocks of (languages, log priors, log probabilities (buckets, languages)) from all rows given."""
    used = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    summed = stored(used.mapInArrow(_counting, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = {r["lang"]: r["n"] for r in summed.where(F.col("bucket") == BUCKETS).select("lang", "n").collect()}  # a row a language
    langs = sorted(texts)
    whole = sum(texts.values()) + len(texts)
    for at in range(0, len(langs), most):
        block = langs[at : at + most]
        place = {x: i for i, x in enumerate(block)}
        counts = np.zeros((BUCKETS, len(block)))
        table = summed.where(F.col("lang").isin(block) & (F.col("bucket") < BUCKETS)).toPandas()  # at most most x buckets rows
        if len(table):
            counts[table["bucket"].to_numpy(np.int64), table["lang"].map(place).to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
        grams = counts + SMOOTHING
        log_probs = np.log(grams) - np.log(grams.sum(axis=0))
        yield block, np.log([texts[x] + 1 for x in block]) - np.log(whole), log_probs.astype(np.float32)
    forget(summed)


def _scored(texts: list[str], priors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log joint probabilities (texts, languages)."""
    out = np.tile(priors, (len(texts), 1))
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def add() -> None:
        if not waiting:
            return
        ids = [ngram_buckets(c) for _, c in waiting]
        bounds = np.concatenate([[0], np.cumsum([3 * x.shape[1] for x in ids])])[:-1]
        sums = np.add.reduceat(matrix[np.concatenate([x.ravel() for x in ids])], bounds, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _ in waiting], sums)

    for i, text in enumerate(texts):
        for piece in _pieces(letters_and_gaps(text)):
            waiting.append((i, piece))
            held += len(piece)
            if held >= PIECE:
                add()
                waiting, held = [], 0
    add()
    return out


def _predicting(model, kind: pa.DataType):
    """Adds a block of languages to the best language so far, its log probability and the log of the sum of all."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, priors, matrix = model.value
        table = letter_table()
        for batch in batches:
            texts, best = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            top, whole = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (4, 5))
            rows = [i for i, t in enumerate(texts) if t and table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()]
            if rows:
                logs = _scored([texts[i] for i in rows], priors, matrix)
                own, most = logs.argmax(axis=1), logs.max(axis=1)
                whole[rows] = np.logaddexp(whole[rows], most + np.log(np.exp(logs - most[:, None]).sum(axis=1)))
                for i, b, x in zip(rows, own, most, strict=True):
                    if x > top[i]:
                        best[i], top[i] = langs[b], x
            columns = [batch.column(0).cast(kind), batch.column(1), batch.column(2), pa.array(best, pa.string()), pa.array(top), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "text", "best", "top", "whole"])

    return predict


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether the id's text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))


def identify_languages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, most: int = MOST_LANGUAGES,
) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score. Learns from the rows not held out."""
    held = F.lit(False) if held_out is None else held_out
    kind = docs.schema[id_col].dataType
    none = F.lit(float("-inf"))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("best"), none.alias("top"), none.alias("whole"))
    for block in fit(docs.where(~held), text_col=text_col, lang_col=lang_col, most=most):
        model = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_predicting(model, to_arrow_type(kind)), rows.schema)
    return rows.select("doc_id", "held_out", F.coalesce("best", F.lit("und")).alias("lang_pred"), F.when(F.col("best").isNull(), 0.0).otherwise(F.exp(F.col("top") - F.col("whole"))).alias("score"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir), held_out=fold("doc_id", 4, 2))
