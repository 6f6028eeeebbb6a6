"""Whitening against exact rational arithmetic and numpy's own covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from duelframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, _x long, n long, whitened double, deviation long, _k string"


def frame(spark, vectors, kind="float"):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], None, None, None, None, None, "clash") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA.replace("array<float>", f"array<{kind}>"))


def integers(v):
    return [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]


def exact_covariance(xs):
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    return sums, [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in xs) / n for j in range(d)] for i in range(d)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + [3, -900, 0, 0.5, 7, 100, 1e4]
    rows = [(i, list(np.float32(v))) for i, v in enumerate(mixed)]
    return rows + [rows[3], rows[3], (None, rows[5][1])]


def test_covariance_is_exact(spark, vectors):
    xs = [integers(v) for _, v in vectors]
    sums, exact = exact_covariance(xs)
    n, found, v = W.covariance(W.usable(frame(spark, vectors).repartition(5)))
    assert (n, found) == (len(xs), sums)
    assert [[float(e) for e in row] for row in exact] == v.tolist()


def test_rows(spark, vectors):
    odd = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] + [0.0] * 6), (903, [float("-inf")] + [0.0] * 6)]
    df = frame(spark, vectors + odd).repartition(3)
    model = W.fit_whitening(df)
    xs = np.array([integers(v) for _, v in vectors], dtype=object)
    n, sums = len(xs), xs.sum(axis=0)
    rows = W.whiten(df, model).collect()
    assert sorted(map(str, (r["vec_id"] for r in rows))) == sorted(str(i) for i, _ in vectors)
    by_id = dict(vectors)
    for r in rows:
        x = integers(by_id[r["vec_id"]])
        z = [n * a - s for a, s in zip(x, sums)]
        assert int(r["deviation"]) == sum(a * a for a in z)
        expected = [sum(a / n * model.vectors[i, k] for i, a in enumerate(z)) / math.sqrt(model.eigenvalues[k]) for k in range(7)]
        assert np.allclose(r["whitened"], expected, rtol=1e-9, atol=1e-9)
    v = np.cov(xs.astype(float).T, bias=True)
    values = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(model.eigenvalues, values, rtol=1e-8)
    assert np.allclose(model.explained, values / np.trace(v), rtol=1e-8)
    assert W.identity_error(df, model) < 1e-9
    assert np.abs(np.cov(np.array([r["whitened"] for r in rows]).T, bias=True) - np.eye(7)).max() < 1e-9


def test_numbers_beyond_machine_integers(spark):
    vectors = [(i, [(-1) ** i * 2.0**40 * (i + 1), 2.0**50 + i, float(i * i)]) for i in range(9)]
    df = frame(spark, vectors, "double")
    xs = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in vectors]
    sums, exact = exact_covariance(xs)
    n, found, v = W.covariance(W.usable(df))
    assert found == sums and [[float(e) for e in row] for row in exact] == v.tolist()
    model = W.fit_whitening(df)
    by_id = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(df, model).collect()}
    assert by_id == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for (i, _), x in zip(vectors, xs)}


def test_components_without_variance_and_limit(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(50, 2)) * 100
    vectors = [(i, [round(float(a)), round(float(b)), round(float(a)) + round(float(b)), 5.0]) for i, (a, b) in enumerate(base)]
    df = frame(spark, vectors)
    model = W.fit_whitening(df)
    assert len(model.eigenvalues) == 2 and W.identity_error(df, model) < 1e-9
    assert len(W.fit_whitening(df, components=1).eigenvalues) == 1
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    flat = W.fit_whitening(same)
    assert flat.explained == [] and W.identity_error(same, flat) == 0.0
    assert [(r["vec_id"], r["whitened"], int(r["deviation"])) for r in W.whiten(same, flat).orderBy("vec_id").collect()] == [(1, [], 0), (2, [], 0)]


def test_empty_table_and_errors(spark):
    for rows in ([], [(1, None)]):
        df = frame(spark, rows)
        model = W.fit_whitening(df)
        assert model.n == 0 and W.whiten(df, model).collect() == []
        assert W.whiten(df, model).dtypes == [("vec_id", "bigint"), ("whitened", "array<double>"), ("deviation", "decimal(38,0)")]
    with pytest.raises(Exception, match="different lengths"):
        W.fit_whitening(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="out of range"):
        W.fit_whitening(frame(spark, [(1, [1e30]), (2, [1.0])]))


def test_query(spark):
    from duelframe.llm.queries import QUERIES

    df = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.toPandas()
    assert len(rows) == 32 * table.count() and rows["identity_error"].iloc[0] < 1e-9
    xs = np.array([[math.floor(64 * e) + 1_000_000 for e in r["embedding"]] for r in table.orderBy("vec_id").collect()], dtype=float)
    centred = xs - xs.mean(axis=0)
    values, q = np.linalg.eigh(centred.T @ centred / len(xs))
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    expected = centred @ q[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.allclose(np.abs(wide), np.abs(expected), atol=1e-6)
