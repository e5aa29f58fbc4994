"""Language, toxicity and quality on held-out rows, and their defined cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sitewise.llm.common import NON_WORD, hash_run
from sitewise.llm.language_id import BUCKETS, SMOOTHING, identify_languages, letters_and_gaps, ngram_buckets, op3_language_id
from sitewise.llm.quality_classifier import classify_quality, site
from sitewise.llm.toxicity import Field, _judged, _plain_gradient, _repeated, op4_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, SF).where("held_out").join(docs, "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).collect()[0]
    assert n > 100 and right > 0.95


def test_languages_equal_brute_force(sample):
    """Naive Bayes by counting n-grams in dictionaries, with the module's buckets."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in sample.select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()]
    counts, texts = defaultdict(Counter), Counter()
    grams = {}
    for doc, text, lang in rows:
        codes = letters_and_gaps(text)
        grams[doc] = Counter(ngram_buckets(codes).ravel().tolist())
        counts[lang].update(grams[doc])
        texts[lang] += 1
    langs = sorted(texts)
    whole = sum(texts.values()) + len(langs)
    want = {}
    for doc, _, _ in rows:
        logs = []
        for lang in langs:
            total = sum(counts[lang].values()) + SMOOTHING * BUCKETS
            logs.append(math.log((texts[lang] + 1) / whole) + sum(n * math.log((counts[lang][b] + SMOOTHING) / total) for b, n in grams[doc].items()))
        top = max(logs)
        want[doc] = (langs[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs))
    docs = sample.join(sample.sparkSession.createDataFrame([(d,) for d, _, _ in rows], "doc_id bigint"), "doc_id")
    for most in (200, 1, 3):  # matrices of all languages, of one each, of three
        got = {r["doc_id"]: r for r in identify_languages(docs, most=most).collect()}
        assert {d: r["lang_pred"] for d, r in got.items()} == {d: lang for d, (lang, _) in want.items()}
        assert all(got[d]["score"] == pytest.approx(p, abs=1e-3) for d, (_, p) in want.items())


def test_language_cases(odd):
    rows = {r["doc_id"]: r for r in identify_languages(odd, held_out=F.lit(False)).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3, 6))
    assert rows[4]["lang_pred"] == "ru"
    assert identify_languages(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(odd, held_out=F.lit(True)).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    rows = op4_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    above = (bad.score.to_numpy()[:, None] > good.score.to_numpy()).mean()
    assert above > 0.9
    assert (good.predicted == 1).mean() < 0.05


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    sf = "/root/testdata/sf0.1"
    rows = op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").toPandas()
    assert (rows[rows.toxic == 1].predicted == 1).mean() >= 0.9
    assert (rows[rows.toxic == 0].predicted == 1).mean() < 0.01


def test_small_parts_go_over_their_steps_again():
    assert [(again, x) for again, x in _repeated(iter("ab"))][:5] == [(False, "a"), (False, "b"), (True, "a"), (True, "b"), (True, "a")]
    assert sum(1 for _ in _repeated(iter("ab"))) == 24 and list(_repeated(iter(range(30)))) == [(False, k) for k in range(30)] and not list(_repeated(iter(())))


def test_toxicity_cases(odd, labels):
    rows = score_toxicity(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r["score"] == 0 and r["spans"] == [] for r in rows if r["doc_id"] in (1, 2, 3))
    assert score_toxicity(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_scores_do_not_depend_on_the_layout(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    one, eight = ({r["doc_id"]: r["score"] for r in score_toxicity(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 8))
    assert one == eight and len(set(one.values())) > 10


def test_gradient_of_chains_without_features_equals_enumeration():
    rng = np.random.default_rng(3)
    field = Field(2)
    field.trans, field.w[-1] = rng.normal(size=(2, 2)), -0.7
    lengths = np.array([1, 3, 3, 4, 1, 6])

    def likelihood(bias, trans):
        """Log likelihood of all words clean."""
        total = 0.0
        for t in lengths:
            weights = []
            for code in range(1 << t):
                tags = [code >> i & 1 for i in range(t)]
                weights.append(bias * sum(tags) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            total += weights[0] - np.log(np.exp(weights).sum())
        return total

    bias, trans = _plain_gradient(field, lengths)
    eps = 1e-5
    assert bias == pytest.approx((likelihood(field.w[-1] + eps, field.trans) - likelihood(field.w[-1] - eps, field.trans)) / (2 * eps), abs=1e-6)
    for i in range(2):
        for j in range(2):
            step = np.zeros((2, 2))
            step[i, j] = eps
            slope = (likelihood(field.w[-1], field.trans + step) - likelihood(field.w[-1], field.trans - step)) / (2 * eps)
            assert trans[i, j] == pytest.approx(slope, abs=1e-6)


def test_evidence_equals_enumeration_of_all_tags():
    """Largest marginal, sum of those over 0.1 and words of small texts, by all taggings of each sentence."""
    words = ["bad", "good", "dull", "vile"]
    data = [np.frombuffer(w.encode(), np.uint8) for w in words]
    known = np.sort([hash_run(d, np.array([0, len(d)]), NON_WORD)[0][0] for d in (data[0], data[3])])
    field = Field(2)
    field.w[:] = [1.5, 2.5, 0.4, -0.3, 0.0, -1.0]
    field.trans = np.array([[0.2, -0.5], [0.1, 0.9]])
    texts = ["bad good. dull", "good dull vile bad. good good", "dull"]
    evidence, _ = _judged(pa.array(texts), known, field, {})
    for text, found in zip(texts, evidence, strict=True):
        marginals = []
        for sentence in text.split("."):
            own = sentence.split()
            on = [int(np.searchsorted(known, h)) if (h := hash_run(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), NON_WORD)[0][0]) in known else None for w in own]
            unary = [
                (field.w[k] if k is not None else 0.0) + (field.w[2] if i and on[i - 1] is not None else 0.0) + (field.w[3] if i + 1 < len(on) and on[i + 1] is not None else 0.0) + field.w[5]
                for i, k in enumerate(on)
            ]
            total, of = 0.0, np.zeros(len(own))
            for code in range(1 << len(own)):
                tags = [code >> i & 1 for i in range(len(own))]
                weight = np.exp(sum(u * t for u, t in zip(unary, tags)) + sum(field.trans[a, b] for a, b in zip(tags, tags[1:])))
                total += weight
                of += weight * np.array(tags)
            marginals += (of / total).tolist()
        used = [x for x in marginals if x > 0.1]
        assert found[0] == pytest.approx(max(marginals)) and found[2] == len(text.replace(".", " ").split())
        assert found[1] <= sum(used) + 1e-9  # sentences without a known word add nothing


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    host, path = site(F.col("source"), F.col("lang"))
    got = classify_quality(docs, labels.where(~held), host=host, path=path).join(labels.where(held), "doc_id").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 50 and len(bad) > 50 and (good[:, None] > bad).mean() > 0.9


def test_sites_with_paths(spark):
    host, path = site(F.col("s"), F.col("l"))
    rows = spark.createDataFrame([("a/b/c", "en"), ("a", "en"), (None, None), ("a/", "en")], "s string, l string").select(host.alias("h"), path.alias("p")).collect()
    assert [tuple(r) for r in rows] == [("a", "b/c"), ("a", "en"), (None, None), ("a", "")]


def test_many_sites_take_the_salted_join(odd, labels, monkeypatch):
    import sitewise.llm.quality_classifier as module

    def rows():
        return sorted(map(str, classify_quality(odd, labels, host=F.col("source"), path=F.col("lang")).collect()))

    want = rows()
    monkeypatch.setattr(module, "BROADCAST_SITES", 0)
    assert rows() == want and len(want) == odd.count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = Field(3)
    field.trans = rng.normal(size=(2, 2))
    unary = rng.normal(size=(1, 5))
    total, want = 0.0, np.zeros(5)
    for code in range(32):
        tags = [code >> i & 1 for i in range(5)]
        weight = np.exp(sum(u * t for u, t in zip(unary[0], tags)) + sum(field.trans[a, b] for a, b in zip(tags, tags[1:])))
        total += weight
        want += weight * np.array(tags)
    assert field.marginals(unary)[0][0] == pytest.approx(want / total)


def test_quality_cases(odd, labels):
    got = classify_quality(odd, labels, host=F.col("source"), path=F.col("lang"))
    assert got.count() == odd.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert classify_quality(odd.limit(0), labels, host=F.col("source"), path=F.col("lang")).count() == 0
    assert classify_quality(odd, labels.limit(0), host=F.col("source"), path=F.col("lang")).count() == odd.count()


def test_sparse_sites_shrink_to_their_host(spark, corpus):
    good, bad = "Plain words of many kinds make a readable line. " * 4, "## $$ ** %% " * 20
    rows = [(k, good, "en", "a") for k in range(60)] + [(100 + k, bad, "en", "b") for k in range(60)] + [(300, good, "fr", "a"), (301, good, "fr", "b")]
    known = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify_quality(corpus(*rows), known, host=F.col("source"), path=F.col("lang")).collect()}
    assert got[300]["path_share"] > got[301]["path_share"] and got[300]["score"] > got[301]["score"]
    assert got[0]["kept"] and not got[100]["kept"]
