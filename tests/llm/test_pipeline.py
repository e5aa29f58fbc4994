import re

import corpus_pipeline


def test_stages_keep_the_columns_and_act(spark, sample):
    docs = sample
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == sample.columns
        docs = spark.createDataFrame(made.collect(), sample.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {d: frozenset(zip(*[(w := re.findall(r"[^\x20\x09-\x0D]+", t.lower()))[i:] for i in range(5)])) for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    # Cut passages aside, no two of those left are near copies.
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) > 0.9 * len(sets[a] | sets[b])]
    assert not near
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_take_odd_rows_clashing_columns_and_empty_tables(spark, odd):
    from pyspark.sql import functions as F

    for name in ("_id", "_new", "_bad", "_text_key", "_text", "_nth", "_host", "_often", "_lines", "c", "component_id"):
        odd = odd.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, "/root/testdata/sf0.001")
            rows = got.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert got.columns == odd.columns and all(r["_id"] == r["_nth"] == r["_bad"] == "mine" for r in rows)
            assert docs.isEmpty() == (not rows)


def test_stages_equal_brute_force(spark, corpus):
    """A small corpus with one case of each kind; the kept texts are worked out by hand."""
    own = {k: " ".join(f"u{k}n{i}" for i in range(60)) for k in range(12)}
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    rows = [(k, f"site menu\n{own[k]}", "en", "site") for k in range(8)]  # a frequent line: goes
    rows += [(20, "too short", "en", "site")]  # rejected
    rows += [(30, f"{own[8]}\nlast words {own[9]}", "en", "a"), (31, f"{own[8]} more\nanother line of {own[10]}", "en", "b")]  # the second's first line matches
    rows += [(40, f"{own[11]}\n" + " ".join(f"z{i}" for i in range(80)), "en", "c"), (41, f"{own[11]} tail\n" + " ".join(f"z{i}" for i in range(79)), "en", "d")]  # both lines match: gone
    rows += [(50, " ".join(f"y{i}" for i in range(70)) + " " + item + " " + " ".join(f"x{i}" for i in range(70)), "en", "e")]  # the item goes
    docs = corpus(*rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {*range(8), 30, 31, 40, 50}
    assert all(kept[k] == own[k] for k in range(8))
    assert kept[30] == rows[9][1] and kept[31] == f"another line of {own[10]}" and kept[40] == rows[11][1]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
    left = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", kept[50].lower())
    windows = {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))}
    assert not any(tuple(left[i : i + 10]) in windows for i in range(len(left))) and {"y0", "y69", "x0", "x69"} <= set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in packed} == set(kept) and len({r["sequence_id"] for r in packed}) == 1 + sum(r["length"] for r in packed) // 2048
