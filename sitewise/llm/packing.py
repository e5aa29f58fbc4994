"""Best-fit packing of tokenised documents into fixed-length training sequences.

Documents become token ids plus an end id; only those longer than a sequence
are cut. Pieces are dealt to packers by hash and each packer runs a bounded-space
online best fit: at most ``open_bins`` bins are open, found through a bitset that
is keyed by free space; when there is no room for one more, the fullest closes.
Spark sorts a packer's pieces, the longest first, so a task that is run
again after a loss packs the same way, and it holds open bins only, not pieces. With
the default bound a packer of ``DOCS_PER_PACKER`` documents seldom has so many bins open at once:
the bound is there for packers of any length, and few bins closed early is what makes few sequences.

Defined cases
* null text: as the empty text, a piece of just the end id.
* null ids are carried through; repeated rows are packed each.
* very long texts: cut into full pieces as they come.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import documents

SEQUENCE = 2048
#: Enough for every large piece of a packer to stay open until small ones come.
OPEN_BINS = 16_384
#: Documents for each packer; more would pack no tighter.
DOCS_PER_PACKER = 20_000
#: Word forms whose ids a task remembers.
CACHE = 1_200_000
#: ASCII marks that never join the letters before them.
_MARKS = b".,;:!?|#$%&*"


def _cut_runs(raw: bytes, at_most: int = 1 << 20) -> Iterator[bytes]:
    """A text in runs that end at ASCII white space, where tokens can't join."""
    start = 0
    while len(raw) - start > at_most:
        cut = max(raw.rfind(mark, start, start + at_most) for mark in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= start:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:]


class WordTokens:
    """Token ids by white-space separated form, remembered across a task.

    The tokenizer drops white space before it splits, and neither its
    normalisation nor its merges reach across an ASCII space; so the ids of a
    text are those of its forms, one after another. Forms are always encoded by
    the tokenizer itself. Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, limit: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _encode(self, forms: list[bytes]) -> None:
        texts = [x.decode() for x in forms]
        letters = [i for i, x in enumerate(texts) if x.isalpha()]
        others = set(range(len(texts))) - set(letters)
        for at in range(0, len(letters), 2000):
            group = letters[at : at + 2000]
            # A form of letters is one word to the tokenizer, so its ids end with its first word end.
            got = self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in group)], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            bounds = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(bounds) != len(group) + 1:  # some letter changes into several words when lower-cased
                others.update(group)
                continue
            raw = ids.tobytes()
            for i, a, b in zip(group, bounds, bounds[1:], strict=False):
                self.known[forms[i]] = raw[a:b]
        rest = sorted(others)
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            self.known[forms[i]] = np.array(got.ids, "<u4").tobytes()

    def learn(self, forms: set[bytes]) -> None:
        """Makes the ids of all these forms known.

        A form's letters, lower-cased if ASCII, and the marks after them are
        words apart: their ids are put together.
        """
        known = self.known
        if len(known) > self.limit:
            known.clear()
        missing: set[bytes] = set()
        parts: list[tuple[bytes, bytes, bytes]] = []
        for form in forms.difference(known):
            core = form.rstrip(_MARKS)
            marked = len(core) < len(form)
            if core.isalpha():
                lower = core.lower()
                if marked or lower != form:
                    parts.append((form, lower, form[len(core) :]))
                missing.add(lower)
            elif marked and core and core.decode().isalpha():
                parts.append((form, core, form[len(core) :]))
                missing.add(core)
            else:
                missing.add(form)
        missing.update({marks for _, _, marks in parts if marks})
        if missing := missing.difference(known):
            self._encode(list(missing))
        for form, core, marks in parts:
            known[form] = known[core] + known[marks] if marks else known[core]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; together they should be a bounded run."""
        forms = [t.split() for t in texts]
        self.learn(set().union(*forms))
        get = self.known.__getitem__
        return [b"".join(map(get, f)) for f in forms]

    def ids_of_all(self, texts: Iterator[bytes], run: int = 1 << 20) -> Iterator[bytes]:
        """The ids of any number of texts of any length, a bounded run at a time."""
        waiting: list[bytes] = []
        held = 0
        for text in texts:
            if len(text) > run:
                yield from self.ids(waiting)
                waiting, held = [], 0
                yield b"".join(b"".join(self.ids([r])) for r in _cut_runs(text, run))
                continue
            waiting.append(text)
            held += len(text)
            if held >= run:
                yield from self.ids(waiting)
                waiting, held = [], 0
        yield from self.ids(waiting)


@cache
def words_of(path: str) -> WordTokens:
    """One for each Python worker: the next task of the worker finds its forms known."""
    return WordTokens(path)


def _tokenised(tokenizer: str, end_id: int, sequence: int, schema: pa.Schema, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        end = end_id.to_bytes(4, "little")
        width = 4 * sequence

        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            texts = (t.as_py() or b"" for t in batch.column(1).cast(pa.binary()))
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids_of_all(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    values = [doc, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    if with_ids:
                        values.append(narrow(part))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                if len(rows[0]) >= 10_000:
                    yield made(rows)
                    rows = [[] for _ in schema]
            yield made(rows)

    return pieces


class OpenBins:
    """Bounded-space best fit: bins keyed by free space, with a bitset of the keys in use."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the fullest open bin that has room, or a new one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            found, free = self.made, self.size
            self.made += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.size - free


def narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each if all fit: most of what is shuffled and sorted is ids."""
    values = np.frombuffer(ids, "<u4")
    return values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else ids


def widened(ids: bytes, length: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * length else ids


def _packed(sequence: int, open_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(sequence, open_bins)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            spots = [bins.put(n) for n in lengths]
            names, whole = [*batch.schema.names, "sequence_id", "offset"], list(batch.columns)
            if "ids" in batch.schema.names:
                k = batch.schema.names.index("ids")
                whole[k] = pa.array([widened(b, n) for b, n in zip(whole[k].to_pylist(), lengths, strict=True)], pa.binary())
            columns = [*whole, pa.array([first + b for b, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pack


def pack_documents(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, docs_per_packer: int = DOCS_PER_PACKER, with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    with_ids: also the piece's token ids as little-endian 32-bit bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    sql = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    if with_ids:
        fields.append(("ids", pa.binary()))
        sql += ", ids binary"
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _tokenised(tokenizer, end_id, sequence, pa.schema(fields), with_ids), sql
    )
    packers = max(1, -(-docs.count() // docs_per_packer))
    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(
        F.desc("length"), "doc_id", "piece", "ids_crc32"
    )
    return dealt.mapInArrow(_packed(sequence, open_bins), f"{sql}, sequence_id bigint, offset bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer=default_tokenizer())
