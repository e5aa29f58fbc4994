"""Fill-in-middle: against slices of Python strings, and exact round trips."""

import hashlib

import numpy as np

from pyspark.sql import functions as F

from sitewise.llm.fill_in_middle import Boundaries, fill_in_middle, op11_fill_in_middle, restored

SF = "/root/testdata/sf0.001"


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def held(made):
    back = made.withColumn("back", restored(F.col("text"), F.col("fim.form")))
    return {(r["doc_id"], r["back"]): (*r["fim"], r["text"]) for r in back.collect()}


def test_rank_and_select():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("aż漢😀\n"), 3000)).encode()
    data = np.frombuffer(text, np.uint8)
    index, begins = Boundaries(data), np.flatnonzero((data & 0xC0) != 0x80)
    at = np.arange(len(data) + 1)
    assert (index.rank(at) == np.searchsorted(begins, at)).all()
    assert (index.select(np.arange(len(begins))) == begins).all()
    assert Boundaries(np.empty(0, np.uint8)).rank(np.array([0])).tolist() == [0]


def test_against_slices_of_strings(corpus):
    rng = np.random.default_rng(2)
    letters = [*"ab <>PSM/", "ż", "漢", "😀", "é", "\u0000", "\n"]
    rows = [(k, "".join(rng.choice(letters, rng.integers(0, 40)))) for k in range(400)]
    rows += [(1000 + k, "é" * n) for k, n in enumerate((1, 63, 64, 65, 511, 512, 513, 5000))]
    rows += [(2000, None), (2001, ""), (2002, "x<P>y"), (2003, "<M>"), (2004, "<S"), (2005, "<P <S M>"), (2006, "x" * 2_500_000), (2007, "漢😀" * 400_000)]
    got = held(fill_in_middle(corpus(*rows)))
    assert got == {(i, t or ""): expected(i, t) for i, t in rows}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_sentinels_that_two_texts_would_make_together(corpus):
    rows = [(k, t) for k, t in enumerate(["a<", "P>b", "<S", ">", "<", "M", ">"] * 30)]
    assert held(fill_in_middle(corpus(*rows).coalesce(1))) == {(i, t): expected(i, t) for i, t in rows}


def test_odd_rows_and_other_columns(odd):
    made = fill_in_middle(odd.withColumn("fim", F.lit(1)))
    assert made.columns == [*odd.columns, "fim"]
    assert sorted(map(repr, made.drop("text", "fim").collect())) == sorted(map(repr, odd.drop("text").collect()))
    want = sorted(repr((r["doc_id"], expected(r["doc_id"], r["text"]))) for r in odd.collect())
    assert sorted(repr((r["doc_id"], (*r["fim"], r["text"]))) for r in made.collect()) == want
    assert fill_in_middle(odd.limit(0)).count() == 0
    assert fill_in_middle(odd.select("text", "doc_id")).columns == ["text", "doc_id", "fim"]


def test_query_restores_every_text(spark, sample):
    got = {r["doc_id"]: r for r in op11_fill_in_middle(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, form, prefix, middle, output = expected(i, t)
        assert tuple(got[i])[1:] == (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
