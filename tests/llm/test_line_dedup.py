import random
import re

from pyspark.sql import functions as F

from sitewise.llm.line_dedup import dedup_lines, drop_similar_lines, line_links


def brute(rows):
    """Removed lines: an earlier line of another class matches, or an equal one is before."""
    lines = []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if words:
                lines.append(((doc, i), words))
    lines.sort(key=lambda x: x[0])
    out = {}
    for k, (place, words) in enumerate(lines):
        out[place] = any(5 * len(words & other) >= 4 * len(words | other) for _, other in lines[:k])
    return out


def found(docs):
    return {(r["doc_id"], r["line"]): r["removed"] for r in dedup_lines(docs).collect()}


def test_whole_table_against_brute_force(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert found(sample) == brute(rows)


def test_hot_words_lose_no_line(corpus, monkeypatch):
    import sitewise.llm.line_dedup as module

    monkeypatch.setattr(module, "HOT", 3)
    monkeypatch.setattr(module, "BLOCK", 4)
    base = [f"common{i}" for i in range(20)]
    rows = []
    for k in range(60):
        words = list(base)
        words[k % 20] = f"other{k % 7}"
        words += [f"tail{k % 5}"] * (k % 2)
        rows.append((k, " ".join(words)))
    assert found(corpus(*rows)) == brute(rows)


def test_match_is_earlier_and_similar(corpus):
    docs = corpus((2, "a b c d e f g h i j\nfresh line here"), (1, "A b c d e f g h i x"))
    rows = {(r["doc_id"], r["line"]): r for r in dedup_lines(docs).collect()}
    assert rows[2, 0]["removed"] and (rows[2, 0]["match_doc_id"], rows[2, 0]["match_line"]) == (1, 0)
    assert not rows[1, 0]["removed"] and not rows[2, 1]["removed"]


def test_drop_keeps_columns_and_clean_documents(corpus):
    docs = corpus((1, "one two three\nunique words", "en", "a"), (2, "one two three", "en", "a"), (3, "one two three\nstill something else", "en", "a"), (4, None))
    kept = {r["doc_id"]: r["text"] for r in drop_similar_lines(docs).collect()}
    assert drop_similar_lines(docs).columns == docs.columns
    assert kept == {1: "one two three\nunique words", 3: "still something else", 4: None}


def test_odd_rows_and_empty_table(odd):
    assert dedup_lines(odd).count() > 0
    assert dedup_lines(odd.limit(0)).count() == 0


def linked(rows):
    """All pairs of different sets of words that match, by their first lines, the later one first."""
    first = {}
    for doc, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if words := frozenset(line.lower().split()):
                first.setdefault(words, (doc, i))
    sets = sorted(first, key=first.get)
    return {(first[x], first[y]) for k, x in enumerate(sets) for y in sets[:k] if 5 * len(x & y) >= 4 * len(x | y)}


def test_no_link_is_lost_whatever_is_hot(corpus, monkeypatch):
    import sitewise.llm.line_dedup as module

    base = [f"common{i}" for i in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"other{k % 7}", *base[k % 20 + 1 :], *[f"tail{k % 5}"] * (k % 2)]) + f"\nlone{k} a b c d") for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(9)]
    pairs = linked(rows)
    assert len(pairs) > 200
    ends = [p for pair in pairs for p in pair]
    for hot in (3, 128):
        monkeypatch.setattr(module, "HOT", hot)
        monkeypatch.setattr(module, "BLOCK", hot)
        found = [((r[0], r[1]), (r[2], r[3])) for r in line_links(corpus(*rows)).collect()]
        assert len(found) == len(pairs) and set(found) == pairs
        for r in dedup_lines(corpus(*rows)).collect():
            own, place = (r["class_doc_id"], r["class_line"]), (r["doc_id"], r["line"])
            assert r["n_links"] == ends.count(own)
            before = [b for a, b in pairs if a == own] + [own] * (place != own)
            assert (r["match_doc_id"], r["match_line"]) == (min(before) if before else (None, None))


def test_words_that_agree_in_their_low_bits_stay_different(spark, corpus):
    """Pairs of words whose hashes agree in the 31 bits that the prefixes hold: four shared words of six are no match."""
    words = spark.range(400_000).selectExpr("concat('w', id) as w").selectExpr("w", "shiftrightunsigned(xxhash64(w), 7) & 2147483647 as b")
    pairs = [r["ws"] for r in words.groupBy("b").agg({"w": "collect_list"}).toDF("b", "ws").where("size(ws) > 1").orderBy("b").limit(8).collect()]
    assert len(pairs) == 8
    rows = [row for k, (x, y, *_) in enumerate(pairs) for row in ((2 * k, f"a{k} b{k} c{k} d{k} {x}"), (2 * k + 1, f"a{k} b{k} c{k} d{k} {y}"))]
    assert not any(found(corpus(*rows)).values()) and line_links(corpus(*rows)).count() == 0
    assert drop_similar_lines(corpus(*rows)).count() == 16


def test_lines_of_all_lengths_against_brute_force(corpus):
    rng = random.Random(5)
    rows = []
    for k, n in enumerate([3, 4, 5, 6, 8, 10, 15, 40, 79, 80, 81, 95, 120, 300, 500] * 2):
        base = [f"{k}w{rng.randrange(4 * n)}" for _ in range(n)]
        for c in range(4):
            line = [w if rng.random() > 0.07 * c else f"x{k}{rng.randrange(n)}" for w in base]
            rows.append((100 * c + k, " ".join(line)))
    assert found(corpus(*rows)) == brute(rows)
    pairs = {((r[0], r[1]), (r[2], r[3])) for r in line_links(corpus(*rows)).collect()}
    assert pairs == linked(rows) and len(pairs) > 20


def test_dropping_removes_what_an_earlier_line_matches(corpus, monkeypatch):
    import sitewise.llm.line_dedup as module

    base = [f"common{i}" for i in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"other{k % 7}", *base[k % 20 + 1 :]]) + f"\nlone{k} a{k} b{k} c d") for k in range(40)]
    want = brute(rows)
    lines = {(d, i): line for d, text in rows for i, line in enumerate(text.split("\n"))}
    for hot in (3, 128):
        monkeypatch.setattr(module, "HOT", hot)
        monkeypatch.setattr(module, "BLOCK", hot)
        kept = {r["doc_id"]: r["text"] for r in drop_similar_lines(corpus(*rows)).collect()}
        assert kept == {d: "\n".join(lines[d, i] for i in (0, 1) if not want[d, i]) for d, _ in rows}


def test_columns_of_any_name_pass_through(corpus):
    docs = corpus((1, "one two three\nunique words"), (2, "one two three"), (3, "one two three\nmore"))
    for name in ("_id", "_new", "_bad", "_text_key", "_text", "_row", "_line", "c", "a"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = drop_similar_lines(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {1, 3}
    assert all(r[name] == "mine" for r in got.collect() for name in docs.columns[5:])


def test_rows_of_a_join_grow_with_the_lines_of_a_word(corpus, monkeypatch):
    """Four times the lines of one word make about four times the rows that are joined, not sixteen times."""
    import sitewise.llm.line_dedup as module

    monkeypatch.setattr(module, "HOT", 3)
    monkeypatch.setattr(module, "BLOCK", 4)
    plain, sides = module._pairs, []

    def counted(later, earlier, *on):
        sides.append(later.count() + earlier.count())
        return plain(later, earlier, *on)

    monkeypatch.setattr(module, "_pairs", counted)
    made = []
    for lines in (50, 200):
        sides.clear()
        rows = [(k, f"common often a{k} b{k} c{k}") for k in range(lines)] + [(1000 + k, f"common often d{k % 3}") for k in range(lines)]
        rows += [(2000 + k, f"common often usual {['x', 'y', 'z'][k % 3]}{k % 40} {'v' * (k % 9 + 1)}") for k in range(lines)]
        assert line_links(corpus(*rows)).count() == len(linked(rows))
        made.append(sum(sides))
    assert made[1] < 6 * made[0]
