import hashlib
import re

import numpy as np
import pytest

from sitewise.llm.decontamination import FMIndex, find_contamination, remove_contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = {}
    for doc, text in rows:
        own, hit, ids = words(text), set(), set()
        for item, other in items:
            theirs = words(other)
            n = min(10, len(theirs))
            for i in range(len(theirs) - n + 1) if n else ():
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == theirs[i : i + n]:
                        hit.update(range(j, j + n))
                        ids.add(str(item))
        out[doc] = (len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "short item"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_against_brute_force_in_blocks_of_any_size(corpus, benchmark):
    rows = [(1, "x ONE, two three four five six seven eight nine ten y"), (2, "two three four five six seven eight nine ten eleven twelve short item"), (3, "a short, item; b short-item"), (4, "clean"), (5, None), (6, "")]
    for block in (3, 12, 200_000):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in find_contamination(corpus(*rows), benchmark, block_words=block).collect()}
        assert got == brute(rows, ITEMS)


def test_passes_hand_on_rows_with_hits_only(spark, corpus, benchmark, monkeypatch):
    import sitewise.llm.decontamination as module

    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{w}" for w in rng.integers(0, 30, rng.integers(1, 25)))) for k in range(40)]
    rows = [(k, " ".join(f"w{w}" for w in rng.integers(0, 40, 30)) + (" " + items[k % 40][1] if k % 3 == 0 else "")) for k in range(60)] + [(60, None), (61, "clean")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    for broadcast in (50_000, 0):
        monkeypatch.setattr(module, "PASS_BLOCKS", 2)
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
        docs = corpus(*rows).repartition(3)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in find_contamination(docs, table, block_words=60).collect()}
        assert got == want and sum(w[4] for w in want.values()) >= 20
        kept = {r["doc_id"]: words(r["text"]) for r in remove_contamination(docs, table, block_words=60).collect()}
        assert {k: len(w) for k, w in kept.items()} == {k: w[0] - w[1] for k, w in want.items() if w[0] > w[1] or not w[0]}


def test_locate_finds_every_occurrence():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 4, 500)
    symbols[-1] = 0
    index = FMIndex(symbols, 4)
    for n in (1, 2, 3):
        for pattern in {tuple(symbols[i : i + n]) for i in range(490)}:
            if 0 in pattern:
                continue
            low, high = index.search(np.array([pattern]), np.array([n]))
            want = [i for i in range(len(symbols) - n + 1) if tuple(symbols[i : i + n]) == pattern]
            assert sorted(index.locate(np.arange(low[0], high[0]))) == want


def test_removal_keeps_the_rest(corpus, benchmark):
    docs = corpus((1, "Before. One two three four five six seven eight nine ten. After"), (2, "clean text"), (3, "short item"), (4, None))
    kept = {r["doc_id"]: r["text"] for r in remove_contamination(docs, benchmark).collect()}
    assert set(kept) == {1, 2, 4} and kept[2] == "clean text"
    assert "Before." in kept[1] and "After" in kept[1] and "three" not in kept[1]


def test_odd_rows_and_empty_tables(odd, benchmark):
    assert find_contamination(odd, benchmark).count() == odd.count()
    assert find_contamination(odd.limit(0), benchmark).count() == 0
    assert find_contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0
