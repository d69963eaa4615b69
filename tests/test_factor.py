"""Correspondence analysis of wide tables against a dense decomposition; modalities of several variables."""

import numpy as np

from corpuslab.operators import factor as X


def table(seed, rows, columns, empty=0.6):
    rnd = np.random.default_rng(seed)
    n = rnd.poisson(np.exp(rnd.standard_normal((rows, 3)) @ rnd.standard_normal((3, columns)) * 0.5) * 2) * (rnd.random((rows, columns)) > empty)
    n[0], n[:, 0] = 1, 1
    return n


def dense(n, axes):
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    return s[:axes] ** 2, u[:, :axes] * s[:axes] / np.sqrt(r)[:, None], v[:axes].T * s[:axes] / np.sqrt(c)[:, None]


def same_up_to_sign(a, b):
    return all(min(np.abs(a[:, k] - b[:, k]).max(), np.abs(a[:, k] + b[:, k]).max()) < 1e-3 for k in range(a.shape[1]))


def test_wide_tables_equal_a_dense_decomposition(spark):
    n = table(1, 30, 50)
    df = spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", int(n[i, j])) for i in range(30) for j in range(50)], "row string, col string, n long")
    rows, columns, values = X.wide_correspondence(df, "row", "col", 3)
    want, f, g = dense(n, 3)
    assert np.allclose(values, want, atol=1e-6)
    got_f = np.array([[r.axis1, r.axis2, r.axis3] for r in rows.orderBy("row").collect()])
    got_g = np.array([[r.axis1, r.axis2, r.axis3] for r in columns.orderBy("col").collect()])
    assert same_up_to_sign(got_f, f) and same_up_to_sign(got_g, g)
    _, few, dense_values = X.correspondence(df, "row", "col", 3)
    assert np.allclose(dense_values, values, atol=1e-6)
    assert same_up_to_sign(np.array([[r.axis1, r.axis2, r.axis3] for r in few.orderBy("col").collect()]), got_g)


def test_more_columns_than_a_matrix_takes(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST", 20)
    n = table(2, 12, 40)
    df = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(12) for j in range(40)], "row long, col long, n long")
    _, columns, values = X.correspondence(df, "row", "col", 2)
    assert np.allclose(values, dense(n, 2)[0], atol=1e-6) and columns.count() == 40


def test_few_rows_need_no_rounds(spark):
    n = table(3, 6, 200)
    cells = [(f"r{i}", f"c{j:03d}", int(n[i, j])) for i in range(6) for j in range(200)]
    df = spark.createDataFrame([*cells, (None, "c001", 50), ("r1", None, 70)], "row string, col string, n long")
    rows, columns, values = X.wide_correspondence(df, "row", "col", 2, most_rounds=0)
    want, f, g = dense(n, 2)
    assert np.allclose(values, want, atol=1e-9)
    got_f = np.array([[r.axis1, r.axis2] for r in rows.orderBy("row").collect()])
    got_g = np.array([[r.axis1, r.axis2] for r in columns.orderBy("col").collect()])
    assert same_up_to_sign(got_f, f) and same_up_to_sign(got_g, g)
    assert (got_g[np.abs(got_g * np.sqrt(n.sum(0))[:, None]).argmax(0), range(2)] > 0).all()


def test_iteration_equals_the_matrix_of_few_rows(spark):
    n = table(4, 30, 50)
    df = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(30) for j in range(50)], "row long, col long, n long")
    one, other = (X.wide_correspondence(df, "row", "col", 2, few=k) for k in (400, 0))
    assert np.allclose(one[2], other[2], atol=1e-6)
    for a, b, key in ((one[0], other[0], "row"), (one[1], other[1], "col")):
        x, y = (np.array([[r.axis1, r.axis2] for r in t.orderBy(key).collect()]) for t in (a, b))
        assert np.abs(x - y).max() < 1e-3


def test_one_column_has_no_axes(spark):
    rows, columns, values = X.wide_correspondence(spark.createDataFrame([("a", "x", 3), ("b", "x", 1)], "row string, col string, n long"), "row", "col")
    assert values == [] and rows.count() == 2 and columns.count() == 1


def test_modalities(spark):
    docs = spark.createDataFrame([(1, " New York ", "Le Monde"), (2, None, ""), (3, "paris", "le monde")], "doc_id long, Town string, paper string")
    got = {(r.doc_id, r.modality) for r in X.modalities(docs, ["Town", "paper"]).collect()}
    assert got == {(1, "town_new_york"), (1, "paper_le_monde"), (3, "town_paris"), (3, "paper_le_monde")}
    assert {r.modality for r in X.modalities(docs, ["Town", "paper"], only_variables=["*town"]).collect()} == {"town_new_york", "town_paris"}
    assert {r.modality for r in X.modalities(docs, ["Town", "paper"], only_modalities=[" *Paper_Le_Monde"]).collect()} == {"paper_le_monde"}
