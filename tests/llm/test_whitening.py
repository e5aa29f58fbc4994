"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitewise.llm import whitening
from sitewise.llm.whitening import one_sided_jacobi, op12_embedding_whitening, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def dense(rows, k=16):
    """(deviations, whitened, explained, n) of rows of finite vectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > values[0] * 1e-12).sum())) if values[0] > 0 else 0
    z = (n * x - sums) / n @ (vectors[:, :k] / np.sqrt(values[:k]))
    return ((n * x - sums) ** 2).sum(axis=1), z, values[:k] / values.sum(), n


def close(made, fitted, ids, rows, k=16):
    deviation, z, explained, n = dense(rows, k)
    got = {}
    for r in made.collect():
        got.setdefault(r["vec_id"], []).append((r["deviation"], r["whitened"]))
    assert {i: len(v) for i, v in got.items()} == {i: ids.count(i) for i in set(ids)}
    own = np.array([got[i][0][1] for i in ids])
    assert [got[i][0][0] for i in ids] == deviation.tolist() and fitted.n == n
    sign = np.sign((own * z).sum(axis=0))
    assert own.shape == z.shape and np.abs(own * sign - z).max() < 1e-8
    assert np.abs(fitted.explained / explained - 1).max() < 1e-10 and fitted.identity_error < 1e-10


def test_jacobi_of_any_shape():
    rng = np.random.default_rng(3)
    for rows, d in ((1, 1), (5, 5), (3, 7), (40, 9), (64, 64)):
        r = rng.normal(size=(rows, d)) * 10.0 ** rng.integers(-5, 5, d)
        s, v = one_sided_jacobi(r)
        want = np.zeros(d)
        want[: min(rows, d)] = np.linalg.svd(r, compute_uv=False)
        assert np.abs(s - want).max() <= 1e-13 * want[0] and np.abs(v.T @ v - np.eye(d)).max() < 1e-13
        # Columns of very unlike lengths keep their relative accuracy.
        assert np.abs(np.linalg.norm(r @ v, axis=0) - s).max() <= 1e-12 * want[0]
    s, v = one_sided_jacobi(np.zeros((2, 3)))
    assert not s.any() and (v == np.eye(3)).all()


def test_query_against_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = op12_embedding_whitening(spark, SF)
    assert got.count() == 16 * len(table)
    _, fitted = whiten(spark.read.parquet(f"{SF}/embeddings.parquet"))
    deviation, z, explained, n = dense(table["embedding"])
    wide = got.toPandas().pivot_table(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert list(range(1, 17)) == sorted(got.select("component").distinct().toPandas()["component"])
    assert np.abs(wide * np.sign((wide * z).sum(axis=0)) - z).max() < 1e-8
    row = got.where("component = 3").first()
    assert abs(row["explained"] / explained[2] - 1) < 1e-10 and row["n"] == n and row["identity_error"] < 1e-10


def test_copies_count_once_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    few = [rng.normal(size=5).astype("float32").tolist() for _ in range(60)]
    rows = few + few[:1] * 80
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA).repartition(7)
    close(*whiten(table), list(range(140)), rows)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    close(*whiten(table), list(range(140)), rows)
    close(*whiten(table, components=2), list(range(140)), rows, 2)


def test_left_out_components(spark):
    rng = np.random.default_rng(5)
    flat = [[float(a), float(b), float(a), 2.0] for a, b in rng.integers(0, 9, (50, 2))]
    made, fitted = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(flat)], SCHEMA))
    assert fitted.components.shape == (4, 2)
    close(made, fitted, list(range(50)), flat)
    fewer = [rng.normal(size=6).tolist() for _ in range(3)]
    assert whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(fewer)], SCHEMA))[1].components.shape == (6, 2)
    for rows in ([], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0)], [(1, [], 0)]):
        made, fitted = whiten(spark.createDataFrame(rows, SCHEMA))
        assert fitted is None and made.count() == 0 and made.columns == ["vec_id", "embedding", "label", "deviation", "whitened"]


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=3).astype("float32").tolist(), None) for i in range(20)] + [(None, [0.5, 0.25, 1.0], 1), (3, [9.0, 1.0, 2.0], 1), (3, [9.0, 1.0, 2.0], 1)]
    bad = [(30, None, 0), (31, [1.0, None, 2.0], 0), (32, [1.0, float("nan"), 2.0], 0), (33, [1.0, float("inf"), 2.0], 0), (34, [1.0], 0), (35, [], 0), (36, [1.0, 2.0, 3.0, 4.0], 0)]
    table = spark.createDataFrame(good + bad, SCHEMA).withColumns({"x": F.lit("x"), "deviation": F.lit(1), "_row": F.lit(2)})
    made, fitted = whiten(table)
    assert made.columns == ["vec_id", "embedding", "label", "x", "_row", "deviation", "whitened"]
    assert sorted(str(r["vec_id"]) for r in made.collect()) == sorted(str(r[0]) for r in good)
    assert fitted.n == 22
    with pytest.raises(Exception, match="no long holds"):
        whiten(spark.createDataFrame([(1, [1e7], 0), (2, [-1e7], 0), (3, [2e7], 0)], "vec_id bigint, embedding array<double>, label int"))[0].collect()
