import zlib
from collections import defaultdict

import numpy as np

from sitewise.llm.packing import OpenBins, default_tokenizer, pack_documents


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_the_tokenizer_and_fill_gapless(sample):
    rows = pack_documents(sample, tokenizer=default_tokenizer(), with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [2048 * i for i in range(len(pieces))]
        assert all(r["length"] == 2048 for r in pieces[:-1])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == ids_of(texts[doc])
    for spots in by_bin.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by_bin) <= least + 2


def test_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.put(8) == (2, 0)  # the bin with 3 left closes
    assert bins.put(3) == (0, 6)  # the other is still open
    assert bins.put(2) == (2, 8)


def test_odd_rows_and_empty_table(odd):
    rows = pack_documents(odd, tokenizer=default_tokenizer()).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert pack_documents(odd.limit(0), tokenizer=default_tokenizer()).count() == 0


def brute_packed(lengths, size, most):
    """Spots by looking through all open bins: the fullest with room takes the piece; at the bound the fullest closes."""
    open_, out, made = [], [], 0
    for n in lengths:
        fits = [b for b in open_ if size - b[1] >= n]
        if fits:
            found = max(fits, key=lambda b: b[1])
        else:
            if len(open_) >= most:
                open_.remove(max(open_, key=lambda b: b[1]))
            found = [made, 0]
            made += 1
            open_.append(found)
        out.append((n, found[1]))
        found[1] += n
        if found[1] == size:
            open_.remove(found)
    return out, made


def test_small_bounds_on_the_whole_table_equal_brute_force(sample):
    for most in (1, 2, 5, 40):
        rows = pack_documents(sample, tokenizer=default_tokenizer(), open_bins=most, docs_per_packer=10**9).collect()
        order = sorted(rows, key=lambda r: -r["length"])
        spots, made = brute_packed([r["length"] for r in order], 2048, most)
        # Pieces of one length may change places among themselves.
        assert sorted(spots) == sorted((r["length"], r["offset"]) for r in rows)
        assert len({r["sequence_id"] for r in rows}) == made
