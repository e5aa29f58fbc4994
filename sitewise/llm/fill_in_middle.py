"""Fill-in-middle: each text is cut at two code points and written anew with its middle last.

A task lays the UTF-8 texts of a bounded run end to end and marks the bytes that begin a code point in a
bitvector of 64-bit words, with the number of marks before every block of eight words in a directory. The number of
marks in a text is its length in code points, and selecting the marks of two ranks gives the byte cuts: no text is
decoded or walked through character by character. Nothing is shuffled.

Defined cases
* null text: empty, so plain, with an empty output. Empty texts and texts that contain a sentinel are plain, too.
* null id: the draws are those of an id without digits.
* rows of one id share their draws; repeated rows each have a row.
* very long texts are a run of their own; code points of any length, combining marks and NUL are units like others.
* other columns pass through as they are; a column named like the struct that is added is replaced.
* an empty table: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.llm.common import CHUNK_BYTES, documents

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are changed, and of a hundred changed ones so many begin with their suffix.
CHANGED, SUFFIX_FIRST = 90, 20
#: Words of a block of the directory.
BLOCK_WORDS = 8

FIM = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


class Boundaries:
    """Rank and select over the bytes that begin a code point, of texts laid end to end."""

    def __init__(self, data: np.ndarray) -> None:
        block = 64 * BLOCK_WORDS
        begins = np.zeros((len(data) // block + 1) * block, bool)
        np.not_equal(data & 0xC0, 0x80, out=begins[: len(data)])
        self.words = np.packbits(begins, bitorder="little").view("<u8")
        self.blocks = self.words.reshape(-1, BLOCK_WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK_WORDS
        earlier = np.bitwise_count(self.blocks[block]) * (np.arange(BLOCK_WORDS) < (word % BLOCK_WORDS)[:, None])
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[block] + earlier.sum(axis=1, dtype=np.int64) + np.bitwise_count(self.words[word] & below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Byte place of the mark that has so many before it."""
        block = np.searchsorted(self.before, rank, "right") - 1
        left = rank - self.before[block]
        counts = np.bitwise_count(self.blocks[block]).astype(np.int64)
        earlier = np.cumsum(counts, axis=1) - counts
        word = (earlier <= left[:, None]).sum(axis=1) - 1
        left -= np.take_along_axis(earlier, word[:, None], 1)[:, 0]
        bits = np.unpackbits(self.blocks[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None]).argmax(axis=1)
        return (block * BLOCK_WORDS + word) * 64 + bit


def _with_sentinel(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether each text contains a sentinel."""
    found = np.zeros(len(cuts) - 1, bool)
    if len(data) >= 3:
        letter = np.zeros(256, bool)
        letter[[ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)]] = True
        at = np.flatnonzero((data[:-2] == ord("<")) & letter[data[1:-1]] & (data[2:] == ord(">")))
        text = np.searchsorted(cuts, at, "right") - 1
        found[text[at + 3 <= cuts[text + 1]]] = True
    return found


def _byte_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes laid end to end, their bounds) of bounded runs of texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, last - row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: the row, its text and four draws."""
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        draws = [batch.column(c).to_numpy() for c in range(2, 6)]
        for row, rows, data, cuts in _byte_runs(batch.column(1)):
            h1, h2, h3, h4 = (h[row : row + rows] for h in draws)
            index = Boundaries(data)
            first = index.rank(cuts)
            n = np.diff(first)
            low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
            ends = cuts[1:]
            # The mark after a text's last one is the next text's.
            a, b = (np.where(u < n, index.select(np.minimum(first[:-1] + u, max(0, int(first[-1]) - 1))), ends) if len(data) else ends for u in (low, high))
            plain = (n == 0) | (h3 % 100 >= CHANGED) | _with_sentinel(data, cuts)
            suffix_first = h4 % 100 < SUFFIX_FIRST
            flat, out = data.tobytes(), []
            for start, x, y, end, whole, turned in zip(cuts.tolist(), a.tolist(), b.tolist(), ends.tolist(), plain.tolist(), suffix_first.tolist(), strict=False):
                if whole:
                    out.append(flat[start:end])
                    continue
                parts = (marks[0], flat[start:x]), (marks[1], flat[y:end])
                out.append(b"".join([*sum(parts[::-1] if turned else parts, ()), marks[2], flat[x:y]]))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            fim = pa.StructArray.from_arrays(
                [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain)], names=["n", "form", "prefix_chars", "middle_chars"]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), pa.array(out, pa.binary()).cast(pa.string()), fim], names=["_row", "_text", "_fim"])


def draws(id_col: str) -> list[Column]:
    """Four numbers below 2^32 from the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its texts changed and a struct ``fim`` of n, form, prefix_chars and middle_chars."""
    others = [c for c in docs.columns if c not in (text_col, "fim")]
    asked = docs.select(F.struct(*others, F.lit(None).cast("string").alias("_none")).alias("_row"), F.coalesce(text_col, F.lit("")).alias("_text"), *draws(id_col))
    kind = T.StructType([asked.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_fim", T.StructType.fromDDL(FIM))])
    made = asked.mapInArrow(_cutting, kind)
    return made.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c != "fim"], F.col("_fim").alias("fim"))


def restored(text: Column, form: Column) -> Column:
    """The text that a changed one was made from. A part holds no sentinel, nor can one arise where two parts meet."""
    parts = F.split(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    back = {k: F.concat(*[F.get(parts, i) for i in order]) for k, order in in_order.items()}
    return F.when(form == "psm", back["psm"]).when(form == "spm", back["spm"]).otherwise(text)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id", "fim.*", F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("fim.form")), 256).alias("restored_sha256")
    )


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 90 AS plain,
         ('0x' || substr(d, 25, 8))::BIGINT % 100 < 20 AS turned
  FROM texts
), cut AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN least(a, b)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN (greatest(a, b) - least(a, b))::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN turned THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""
