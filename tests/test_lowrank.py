"""The truncated SVD against numpy's on the whole matrix."""

import numpy as np
import pytest

from threadtide.operators import lowrank, vectors


def sparse(spark, a):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "id long, at array<int>, w array<double>").repartition(4)


def test_gram_product(spark):
    rng = np.random.default_rng(0)
    a = rng.random((70, 600)) * (rng.random((70, 600)) < 0.05)
    a[3] = 0
    block = rng.normal(size=(600, 5))
    assert np.allclose(lowrank.gram_product(sparse(spark, a), block), a.T @ (a @ block))


@pytest.mark.parametrize("shape, dims", [((300, 400), 20), ((40, 500), 30), ((200, 8), 62), ((30, 90), 62)])
def test_axes_and_values(spark, shape, dims):
    rng = np.random.default_rng(1)
    a = (rng.random(shape) * (rng.random(shape) < 0.1)) @ np.diag(1 / (1 + np.arange(shape[1])) ** 0.5)
    rows = sparse(spark, a)
    basis, values = lowrank.axes(rows, shape[1], min(dims, shape[1]))
    want = np.linalg.svd(a, compute_uv=False)
    n = min(len(want), len(values))
    assert np.allclose(values[:n], want[:n], rtol=1e-6, atol=1e-7) and np.allclose(values[n:], 0, atol=1e-6)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    got = {r["id"]: r["x"] for r in lowrank.projected(rows, "id", basis, "x").collect()}
    assert np.allclose([got[i] for i in range(shape[0])], a @ basis, atol=1e-9)


def test_values_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, names = vectors.unit_rows(docs, "doc_id", "text", 1000)
    a = np.zeros((200, len(names)))
    for i, r in enumerate(rows.collect()):
        a[i, r["at"]] = r["w"]
    full = a.any(axis=1)
    assert full.sum() > 150 and np.allclose(np.linalg.norm(a[full], axis=1), 1)
    lsa, values = vectors.svd_project(docs, "doc_id", "text", 50, 1000)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False)[:50], rtol=1e-6)
    assert lsa.count() == full.sum() and len(lsa.first()["lsa"]) == 50


def test_the_norm_of_a_row_is_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc " * 3), (2, "aa"), (None, "cc dd"), (None, "dd"), (3, None)], "k long, t string")
    rows, names = vectors.unit_rows(docs, "k", "t")
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # for every cell of a row, it would be
    idf = {t: np.log(7 / (n + 1)) + 1 for t, n in {"aa": 2, "bb": 2, "cc": 2, "dd": 1}.items()}
    for r in rows.collect():
        tf = {1: {"aa": 1, "bb": 2}, 2: {"aa": 1, "bb": 3, "cc": 3}, None: {"cc": 1, "dd": 2}}[r["k"]]
        w = np.array([tf[t] * idf[t] for t in sorted(tf)])
        assert [names[i] for i in r["at"]] == sorted(tf) and np.allclose(r["w"], w / np.linalg.norm(w))
