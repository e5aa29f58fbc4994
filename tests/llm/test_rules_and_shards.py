"""Quality rules, sharding and substring dedup."""

import re
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitewise.llm.common import LOWER, NON_WORD, hash_run
from sitewise.llm.quality_rules import quality_rules
from sitewise.llm.sharding import differenced, kk_labels, shard_documents
from sitewise.llm.substring_dedup import substring_dedup

ASCII = str.maketrans(ascii_uppercase, ascii_lowercase)
PROSE = " ".join(f"word{i}" for i in range(80))


def test_boilerplate_goes_and_depleted_documents_are_rejected(corpus):
    menu = "Home About Contact Imprint and all the usual links of a page " * 9
    rows = [(k, f"{menu}\n{' '.join(f'u{k}_{i}' for i in range(20))}", "en", "site") for k in range(12)]
    rows += [(100, f"{menu}\n" + " ".join(f"long{i}" for i in range(400)), "en", "site"), (200, f"{menu}\n" + " ".join(f"other{i}" for i in range(400)), "en", "other")]
    got = {r["doc_id"]: r for r in quality_rules(corpus(*rows)).collect()}
    assert not any(got[k]["kept"] for k in range(12)) and got[100]["kept"] and got[200]["kept"]
    kept = quality_rules(corpus(*rows), keep_columns=True)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == corpus((1, "x")).columns and set(texts) == {100, 200}
    assert texts[100] == " ".join(f"long{i}" for i in range(400)) and texts[200] == rows[-1][1]


def test_kept_texts_lose_their_frequent_lines(corpus):
    own = {k: " ".join(f"u{k}_{i}" for i in range(60)) for k in range(14)}
    rows = [(k, f"  HOME  menu{k % 2} \n{own[k]}\n\nhome menu{k % 2}\nImprint", "en", "site") for k in range(12)]
    # Another host with the same lines has too few documents for them to be frequent.
    rows += [(12, f"home menu0\n{own[12]}\nImprint", "en", "other"), (13, own[13], None, None)]
    kept = {r["doc_id"]: r["text"] for r in quality_rules(corpus(*rows), keep_columns=True).collect()}
    assert kept == {k: f"{own[k]}\n" for k in range(12)} | {12: rows[12][1], 13: own[13]}


def test_line_limit_is_a_share_of_the_hosts_documents(corpus):
    # Nine copies among a hundred documents: no line of theirs is in more than a tenth.
    rows = [(k, PROSE, "en", "site") for k in range(9)] + [(100 + k, " ".join(f"v{k}_{i}" for i in range(60)), "en", "site") for k in range(91)]
    assert all(r["kept"] for r in quality_rules(corpus(*rows)).collect())
    # Eleven are: documents count, whether their texts are equal or not.
    got = quality_rules(corpus(*rows, (200, PROSE, "en", "site"), (201, PROSE, "en", "site"))).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {*range(9), 200, 201}


def test_rows_of_one_id_are_one_document(corpus):
    rows = [(1, f"menu\n{PROSE}", "en", "site")] * 12 + [(100 + k, " ".join(f"v{k}_{i}" for i in range(60)), "en", "site") for k in range(5)]
    assert all(r["kept"] for r in quality_rules(corpus(*rows)).collect())


def test_many_hosts_take_the_salted_join(corpus, monkeypatch):
    import sitewise.llm.quality_rules as module

    rows = [(k, f"menu line\n{' '.join(f'u{k}_{i}' for i in range(60))}", "en", f"site{k % 2}") for k in range(24)]
    want = sorted(map(tuple, quality_rules(corpus(*rows), keep_columns=True).collect()))
    monkeypatch.setattr(module, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, quality_rules(corpus(*rows), keep_columns=True).collect())) == want and len(want) == 24 and "menu" not in want[0][1]


def test_rules_on_odd_rows(odd):
    got = {r["doc_id"]: r for r in quality_rules(odd).collect()}
    assert quality_rules(odd).count() == odd.count() and got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[6]["n_symbols"] == 6 and got[6]["n_dup_lines"] == 1 and got[6]["n_repeat_words"] == 6
    assert quality_rules(odd.limit(0)).count() == 0


def test_differencing_is_tighter_than_dealing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 10_000, 300)
    sums = np.zeros((300, 8), np.int64)
    sums[:, 0] = sizes
    shard = differenced(sums)[:, 0]
    load = np.bincount(shard, sizes, 8)
    assert load.max() - load.min() <= 50


def brute_differenced(sizes, k):
    """Karmarkar-Karp by looking through all partial partitions; sets of the groups of each part."""
    parts = [[(n, {i})] + [(0, set())] * (k - 1) for i, n in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        x, y = parts.pop(), parts.pop()
        parts.append(sorted(((a + b, i | j) for (a, i), (b, j) in zip(x, y[::-1])), key=lambda p: -p[0]))
    return parts[0]


def test_differencing_equals_brute_force():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        k = int(rng.integers(2, 9))
        sizes = np.unique(rng.integers(1, 10**9, int(rng.integers(1, 60))))
        sums = np.zeros((len(sizes), k), np.int64)
        sums[:, 0] = sizes
        place = differenced(sums)[:, 0]
        want = {frozenset(g) for _, g in brute_differenced(sizes.tolist(), k) if g}
        assert {frozenset(np.flatnonzero(place == p).tolist()) for p in set(place.tolist())} == want


def test_two_shards_of_few_groups_are_near_the_optimum():
    sizes = np.array([801, 700, 655, 602, 520, 440, 333, 210, 120, 77])
    sums = np.zeros((10, 2), np.int64)
    sums[:, 0] = sizes
    place = differenced(sums)[:, 0]
    best = min(abs(int(sizes.sum()) - 2 * sum(int(s) for i, s in enumerate(sizes) if code >> i & 1)) for code in range(1 << 10))
    assert abs(int(sizes[place == 0].sum()) - int(sizes[place == 1].sum())) <= best + 77


def test_shards_keep_groups_whole_and_bytes_even(spark, sample):
    rows = shard_documents(sample).collect()
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    where, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8


def test_blocks_combine(spark):
    rows = [(f"k{i}", int(i * 37 % 1009 + 1)) for i in range(900)]
    labels = {r["k"]: r["shard"] for r in kk_labels(spark.createDataFrame(rows, "k string, n bigint"), "k", "n", 8, block_rows=64).collect()}
    load = Counter()
    for k, n in rows:
        load[labels[k]] += n
    assert len(labels) == 900 and max(load.values()) - min(load.values()) < 100


def test_shards_of_odd_rows(odd):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count() and all(r["size"] >= 1 for r in rows)
    assert shard_documents(odd.limit(0)).count() == 0


def test_repeated_passages_go_and_the_first_stays(corpus):
    passage = " ".join(f"The {i} shared sentence says what others say." for i in range(12))
    rows = [(k, f"{' '.join(f'Own{k}x{i} text here.' for i in range(30))} {passage} {' '.join(f'End{k}x{i} of it.' for i in range(30))}") for k in range(5)]
    rows.append((9, " ".join(f"lone{i} words." for i in range(60))))
    got = {r["doc_id"]: r for r in substring_dedup(corpus(*rows), with_text=True).collect()}
    assert got[0]["n_removed"] == 0 and got[9]["n_removed"] == 0
    for k in range(1, 5):
        assert got[k]["n_removed"] == len(passage)
        assert "shared" not in got[k]["text"] and f"Own{k}x29 text here." in got[k]["text"] and f"End{k}x0 of it." in got[k]["text"]


def brute_spans(rows, span_words=14):
    """Character ranges to remove, by comparing the words of all runs themselves; only the order of words inside long sentences is the module's."""
    def cuts(hashes, ends):
        """A bound behind each sentence, and in one of over 24 words behind words whose hash comes first among the four on either side of the same sentence; of equal ones the first."""
        bounds, first = [0], 0
        for i in range(len(hashes)):
            if not ends[i] and i < len(hashes) - 1:
                continue
            if i + 1 - first > 24:
                for k in range(first, i):
                    near = range(max(first, k - 4), min(i, k + 4) + 1)
                    if min(near, key=lambda j: (hashes[j], j)) == k:
                        bounds.append(k + 1)
            bounds.append(i + 1)
            first = i + 1
        return bounds

    def sentences(text):
        words = [(m.group().translate(ASCII), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        ends = [bool(re.search(r"[.!?\n]", text[e : words[i + 1][1] if i + 1 < len(words) else None])) for i, (_, _, e) in enumerate(words)]
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        hashes = hash_run(data, np.array([0, len(data)]), NON_WORD)[0]
        assert len(hashes) == len(words)
        return words, cuts(hashes.tolist(), ends)

    seen, out = {}, {}
    for doc, text in sorted(rows):
        words, bounds = sentences(text)
        hit = set()
        last = len(bounds) - 1
        spans = set()
        for i in range(last):
            if fits := [j for j in range(i + 2, last + 1) if bounds[j] - bounds[i] >= span_words]:
                spans.add((i, fits[0]))
        for j in range(last + 1):
            if fits := [i for i in range(j - 1) if bounds[j] - bounds[i] >= span_words]:
                spans.add((fits[-1], j))
        for i, j in sorted(spans):
            a, b = bounds[i], bounds[j]
            if seen.setdefault(tuple(w for w, _, _ in words[a:b]), (doc, a)) != (doc, a):
                hit.add((words[a][1], words[b - 1][2] + len(re.match(r"[.!?]*", text[words[b - 1][2] :]).group())))
        merged = []
        for a, b in sorted(hit):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[doc] = [tuple(m) for m in merged]
    return out


def test_spans_of_the_whole_table_equal_brute_force(sample):
    want = brute_spans([(r["doc_id"], r["text"]) for r in sample.collect()])
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in substring_dedup(sample).collect()}
    assert got == want and sum(map(len, want.values())) > 20


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_with_keys_alike_in_half_their_bits(spark, corpus, doc_id):
    """Clean texts beside texts with a repeat, of the same (or no) id, whose hashes agree in their upper 31 bits."""
    own = " ".join(f"Word {i} of it stands here." for i in range(6))
    n = spark.range(200_000)
    clean = n.select(F.concat(F.lit("c"), "id", F.lit(f" one. {own}")).alias("clean"))
    twice = n.select(F.concat(F.lit("r"), "id", F.lit(f" one. {own} between. {own}")).alias("twice"))
    key = lambda c: F.shiftrightunsigned(F.xxhash64(c), 33).alias("k")
    pairs = clean.select("clean", key("clean")).join(twice.select("twice", key("twice")), "k").select("clean", "twice").distinct().collect()
    assert len(pairs) >= 3
    rows = [(doc_id, r[k]) for r in pairs for k in ("clean", "twice")]
    got = substring_dedup(corpus(*rows), with_text=True).collect()
    assert len(got) == len(rows)
    assert all((r["n_removed"] > 0) == (r["n_chars"] > 300) for r in got) and {r["text"] for r in got if not r["n_removed"]} == {r["clean"] for r in pairs}


def test_a_passage_within_long_sentences_is_found(corpus):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"a{k}x{i}" for i in range(50)) + f" {passage} " + " ".join(f"b{k}x{i}" for i in range(50))) for k in range(2)]
    got = {r["doc_id"]: r for r in substring_dedup(corpus(*rows), with_text=True).collect()}
    assert got[0]["n_removed"] == 0 and 0.6 * len(passage) <= got[1]["n_removed"] <= len(passage)


def test_spans_of_odd_rows(odd):
    got = substring_dedup(odd, with_text=True)
    assert got.count() == odd.count() and substring_dedup(odd.limit(0)).count() == 0
