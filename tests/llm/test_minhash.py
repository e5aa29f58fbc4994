import re

import numpy as np

from sitewise.llm.minhash import block_links, drop_near_duplicates, near_duplicates


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    sets = {}
    for doc, text in rows:
        sets[doc] = shingles(text)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def found(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, **options).collect()}


def test_sample_against_brute_force(sample):
    assert found(sample) == brute([(r["doc_id"], r["text"]) for r in sample.collect()])


def test_large_group_in_small_blocks(corpus):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(120, 4, replace=False):
            words[at] = f"n{k}_{at}"
        rows.append((k, " ".join(words)))
    assert found(corpus(*rows), block=1500) == brute(rows)


def test_block_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 25).astype(np.uint64)) for _ in range(60)]
    roots = np.arange(60)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    i, j = block_links(sets, roots, 70, tile=16)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want
    i, j = block_links(sets, roots, 70, other=25, tile=16)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in want if a < 25 <= b}


def test_one_of_each_group_stays(corpus):
    text = " ".join(f"w{i}" for i in range(50))
    docs = corpus((5, text), (3, text), (9, text + " more"), (1, "something else entirely here"), (2, ""), (4, None))
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == [1, 2, 3, 4]


def test_odd_rows_and_empty_table(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["kept"] for r in rows if r["doc_id"] == 5)
    assert near_duplicates(odd.limit(0)).count() == 0
