"""Shared helpers: intermediate tables in the shared folder and vectorised word hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

#: Text bytes hashed at once inside a task; bounds the temporary arrays.
CHUNK_BYTES = 1 << 20


#: Removes a query's shuffle files as soon as it has ended; what follows reads the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests) gets a temporary folder; on a cluster that is an error,
    as a machine's own folder would be lost with the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sitewise-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def configured(spark: SparkSession, **settings: str) -> Iterator[None]:
    """SQL settings for one step, put back afterwards; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; executors may be lost afterwards without recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with configured(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- word hashes

_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_table()
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U64), np.full(n - 1, 0xD6E8FEB86659FD93, _U64)]))


_POWERS = _powers(1 << 12)

#: White space of the contracts: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but digits, lower-case letters and non-ASCII bytes.
NON_WORD = np.zeros(256, bool)
NON_WORD[:0x80] = True
NON_WORD[0x30:0x3A] = False
NON_WORD[0x61:0x7B] = False


def hash_run(data: np.ndarray, cuts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of several texts laid end to end: hashes, words per text, first bytes, lengths.

    cuts has the texts' byte bounds, first 0 and last len(data).
    """
    global _POWERS
    texts = len(cuts) - 1
    word = ~separators[data]
    if not word.any():
        none = np.empty(0, np.int64)
        return np.empty(0, _U64), np.zeros(texts, np.int64), none, none
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    inner = cuts[1:-1]
    first[inner[inner < len(data)]] = True
    first &= word
    starts = np.flatnonzero(first)
    at = np.flatnonzero(word)
    bounds = np.searchsorted(at, starts)
    lengths = np.diff(np.append(bounds, len(at)))
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = _powers(1 << longest.bit_length())
    place = np.arange(len(at)) - np.repeat(bounds, lengths)
    hashes = np.add.reduceat(_BYTE_VALUE[data[at]] * _POWERS[place], bounds)
    hashes = mix64(hashes + lengths.astype(_U64) * _U64(0x9E3779B97F4A7C15))
    return hashes, np.diff(np.searchsorted(starts, cuts)), starts, lengths


def pieces(data: np.ndarray, separators: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about CHUNK_BYTES that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data):
            gap = np.flatnonzero(separators[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        yield data[at:end]
        at = end


def runs(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes laid end to end with A-Z lower-cased, their bounds) of bounded runs of texts; nulls are empty."""
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last - row, LOWER[data[offsets[row] : offsets[last]]], offsets[row : last + 1] - offsets[row]
        row = last


def hashed_texts(column: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lower-cases A-Z and hashes the words of each text, a bounded run at a time.

    Yields (first row, rows, hashes of all their words, words per row). Nulls
    have no words. Hashes are 64-bit: two different words agree with a
    probability of about 5e-20.
    """
    for row, rows, run, cuts in runs(column):
        if rows == 1 and len(run) > CHUNK_BYTES:
            hashes = np.concatenate([hash_run(p, np.array([0, len(p)]), separators)[0] for p in pieces(run, separators)])
            yield row, 1, hashes, np.array([len(hashes)])
        else:
            yield row, rows, *hash_run(run, cuts, separators)[:2]
