import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def made(*rows):
        whole = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(whole, SCHEMA)

    return made


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and a column with a clashing name."""
    rows = [
        (1, None, None, None, None), (None, "one two three four five six", "en", "a", 1), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4),
        (4, "слово " * 60, "ru", "b", 360), (4, "слово " * 60, "ru", "b", 360), (5, "x" * 300_000, "en", "a", 300_000), (6, "# $ %\n# $ %", "en", "a", 9),
        (7, " ".join(f"w{i}" for i in range(40_000)) + ".", "en", "a", 1),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"_key": F.lit(1), "_row": F.lit("x"), "id": F.lit(2)})


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
