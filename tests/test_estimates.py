import pytest

from sitewise import schemas
from sitewise.functions.text import cache_key
from sitewise.operators.estimates import cache_misses, estimate_cells, parsed, read_cache, with_keys

GOOD = '{"wealth_score": 7, "area_character": "mixed", "confidence": 0.5}'


def body(wealth="7", area='"mixed"', confidence="0.5"):
    return f'{{"wealth_score": {wealth}, "area_character": {area}, "confidence": {confidence}}}'


CASES = [
    (GOOD, 7), (f"```json\n{GOOD}\n```", 7), (f"  \n```\n{GOOD}```  ", 7), (f"Sure: {GOOD} done", 7), (body("7.9"), 7), (body('"7"'), 7), (body("true"), 1), (body(area='" Mixed "'), 7),
    (body('"7.5"'), None), (body("null"), None), (body("NaN"), None), (body("Infinity"), None), (body("11"), None), (body("-1"), None), (body(confidence="1.2"), None),
    (body(area='"park"'), None), (body(area="null"), None), ('{"wealth_score": 7}', None), ("no json", None), ("", None), (None, None), ("[1, 2]", None), ("5", None), ("{", None),
]


def test_replies(spark):
    got = parsed(spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")).orderBy("i").collect()
    assert [r["wealth_score"] for r in got] == [w for _, w in CASES]
    assert all((r["error"] is None) == (w is not None) for r, (_, w) in zip(got, CASES))
    assert got[7]["area_character"] == "mixed"


def test_key(spark):
    import hashlib

    got = spark.createDataFrame([("тест",)], "p string").select(cache_key("m", __import__("pyspark.sql.functions", fromlist=["col"]).col("p"))).collect()[0][0]
    assert got == hashlib.sha256("m\nтест".encode()).hexdigest()


def test_cells_of_one_context_share_a_call_and_the_cache_holds(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    contexts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "cell_id string, context string")

    def maker():
        def ask(text):
            with open(calls, "a") as f:
                f.write("1\n")
            return GOOD

        return ask

    for _ in range(2):
        got = estimate_cells(contexts, maker, model_name="m", cache_path=cache)
        assert {(r["cell_id"], r["wealth_score"]) for r in got.collect()} == {("a", 7), ("b", 7), ("c", 7)}
        assert len(calls.read_text().split()) == 2
    assert cache_misses(with_keys(contexts, "m"), read_cache(spark, cache)).count() == 0
    assert cache_misses(with_keys(contexts, "other"), read_cache(spark, cache)).count() == 2


def test_invalid_replies_are_asked_again(spark, tmp_path):
    contexts = spark.createDataFrame([("a", "x"), ("b", "y")], "cell_id string, context string")
    count = tmp_path / "n"

    def maker():
        def ask(text):
            n = int(count.read_text()) if count.exists() else 0
            count.write_text(str(n + 1))
            return GOOD if n >= 2 else "bad"

        return ask

    got = estimate_cells(contexts, maker, model_name="m", cache_path=str(tmp_path / "cache"), max_retries=2)
    assert got.where("wealth_score = 7").count() == 2
    with pytest.raises(RuntimeError):
        estimate_cells(contexts, lambda: lambda t: "bad", model_name="m", cache_path=str(tmp_path / "none"), max_retries=1)
    lenient = estimate_cells(contexts, lambda: lambda t: "bad", model_name="m", cache_path=str(tmp_path / "none"), max_retries=0, strict=False)
    assert lenient.where("wealth_score is null").count() == 2
    assert read_cache(spark, str(tmp_path / "none")).count() == 0
    assert read_cache(spark, str(tmp_path / "missing")).schema.names == spark.createDataFrame([], schemas.CACHE).schema.names
