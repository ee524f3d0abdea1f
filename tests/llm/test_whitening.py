"""Whitening against the plain formulas, on odd and on badly scaled vectors."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, most=16):
    """{vec_id: (n, deviation, x - mean)}, and covariance, of sound rows of one length."""
    sound = [(i, v) for i, v in rows if v is not None and all(t is not None and np.isfinite(t) for t in v)]
    x = {i: [int(np.floor(64 * t)) + 1_000_000 for t in v] for i, v in sound}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = [[n * sum(r[i] * r[j] for r in fit) - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]
    return x, n, s, np.array([[t / (n * n) for t in r] for r in exact]), {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x.items()}


def check(got, rows, components):
    x, n, s, cov, deviation = plain(rows)
    e = np.linalg.eigvalsh(cov)[::-1]
    assert sorted({(r["vec_id"], r["component"]) for r in got}) == sorted({(i, k) for i in x for k in range(1, components + 1)})
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) <= 1e-4 * r["explained"]
    distinct = {tuple(v): i for i, v in x.items()}
    ids = sorted(distinct.values())
    at = {i: k for k, i in enumerate(ids)}
    y = np.zeros((len(ids), components))
    for r in got:
        if r["vec_id"] in at:
            y[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    c = np.cov(y.T, bias=True).reshape(components, components)
    assert np.abs(c - np.eye(components)).max() <= 1e-4 and max(r["identity_error"] for r in got) <= 1e-4


def test_random_vectors_with_repeats_and_gaps(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 20)) * rng.uniform(0.2, 3, 20)
    rows = [(i, [float(t) for t in x]) for i, x in enumerate(v)] + [(900 + i, [float(t) for t in v[i % 3]]) for i in range(60)]
    odd = [(1000, None), (1001, [None] + [0.0] * 19), (1002, [float("nan")] * 20), (1003, [float("inf")] * 20)]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows + odd], SCHEMA).withColumn("component", F.lit(3)).withColumn("n", F.lit("x"))
    got = whitening.whitened(df.repartition(5)).collect()
    check(got, rows, 16)


@pytest.mark.parametrize("factor", [1.0, 1e6, 1e9])
def test_badly_scaled(spark, factor):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 6)) * np.array([factor, 30, 20, 10, 5, 2])
    mixed = v @ np.linalg.qr(rng.normal(size=(6, 6)))[0] if factor == 1.0 else v
    rows = [(i, [float(t) for t in x]) for i, x in enumerate(mixed)]
    got = whitening.whitened(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect()
    x, n, _, cov, deviation = plain(rows)
    for r in got:
        assert r["deviation"] == Decimal(deviation[r["vec_id"]]) and r["identity_error"] <= 1e-4
    y = np.zeros((200, 6))
    for r in got:
        y[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(y.T, bias=True) - np.eye(6)).max() <= 1e-4


def test_without_variance_lengths_and_empty(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [0.5], 0), (4, [0.75], 0), (5, [], 0), (None, [0.5], 0)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["whitened"], r["explained"], r["identity_error"]) for r in got if r["vec_id"] in (1, 2)) == [(i, k, 1, None, None, None) for i in (1, 2) for k in (1, 2)]
    ones = {r["vec_id"]: r for r in got if r["vec_id"] in (3, 4, None)}
    assert ones[3]["n"] == 2 and abs(ones[3]["whitened"]) == pytest.approx(1) and ones[None]["whitened"] == ones[3]["whitened"] == -ones[4]["whitened"]
    assert not any(r["vec_id"] == 5 for r in got)
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cross_products_of_wide_entries():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**61), 2**61, size=(70, 3))
    full = np.concatenate([x.astype(object), np.ones((70, 1), dtype=object)], axis=1)
    assert (whitening.cross_products(x) == full.T.dot(full)).all()


def test_the_query_on_its_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"

    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    check(queries.op11_whitening(spark, sf).collect(), rows, 16)
