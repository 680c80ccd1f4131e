"""Whitening against numpy on all rows at once."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibflow.llm import queries, whitening
from bibflow.llm.whitening import Spectrum, rank_one


def brute(rows, components=4):
    """Per usable row: its x, and its whitened numbers up to sign; and the fit, all of it in plain numpy."""
    fine = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {k: None for k, _ in fine}
    xs = np.array([[math.floor(256 * float(c)) for c in v] for _, v in fine], dtype=np.int64)
    fit = np.unique(xs, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    best = np.argsort(-values)[:components]
    white = (xs - sums / n) @ vectors[:, best] / np.sqrt(values[best])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in xs]
    return [k for k, _ in fine], n, deviation, white, values[best] / np.trace(cov)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2 ** 31), st.sampled_from(["plain", "ties", "zeros", "scales", "few"]))
def test_rank_one_equals_eigh(d, seed, kind):
    rng = np.random.default_rng(seed)
    values, vectors = np.sort(rng.random(d)), np.linalg.qr(rng.normal(size=(d, d)))[0]
    if kind == "ties":
        values = np.sort(np.round(values * 2))
    if kind == "few":
        values = np.zeros(d)
    if kind == "scales":
        values = np.sort(10.0 ** rng.integers(-9, 9, d))
    vector = rng.normal(size=d)
    if kind == "zeros":
        vector = vectors @ (rng.normal(size=d) * (rng.random(d) < 0.4))
    whole = vectors @ np.diag(values) @ vectors.T + 0.7 * np.outer(vector, vector)
    after, turned = rank_one(values, vectors, 0.7, vector)
    scale = max(1.0, np.abs(whole).max())
    assert np.abs(turned.T @ turned - np.eye(d)).max() < 1e-10
    assert np.abs(turned @ np.diag(after) @ turned.T - whole).max() < 1e-10 * scale
    assert np.abs(np.sort(after) - np.linalg.eigvalsh(whole)).max() < 1e-10 * scale


def test_updates_and_merges():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 12)) * 40)
    parts = []
    for some in np.array_split(x, 5):
        s = Spectrum.empty(12)
        for row in some:
            s.add(row)
        parts.append(s)
    whole = Spectrum.empty(12)
    whole.merge(Spectrum.empty(12))
    for s in parts:
        whole.merge(s)
    centred = x - x.mean(0)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(0))
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, centred.T @ centred)


def _same(found, rows, key="vec_id"):
    ids, n, deviation, white, explained = brute(rows)
    told = {}
    for r in found:
        told.setdefault((r[key], r["deviation"]), {})[r["component"]] = r
    assert sorted(told) == sorted(set(zip(ids, deviation)))
    by = {(i, d): w for i, d, w in zip(ids, deviation, white)}
    for k in range(white.shape[1]):
        ours = np.array([told[i][k + 1]["whitened"] for i in by])
        theirs = np.array([by[i][k] for i in by])
        sign = np.sign((ours * theirs).sum())
        assert np.allclose(ours * sign, theirs, atol=1e-8)
    one = next(iter(told.values()))
    assert {r["n"] for r in found} == {n}
    assert all(r["identity_error"] < 1e-9 and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) for r in one.values())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                  "explained": "double", "identity_error": "double"}
    found = found.collect()
    _same(found, rows)
    assert len(found) == 4 * sum(1 for _, v in rows if v)


def _scored(spark, rows, columns="vec_id bigint, embedding array<float>"):
    df = spark.createDataFrame(rows, columns).repartition(3)
    model = whitening.fit(df)
    return model, whitening.transform(df, model)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=6).astype(np.float32)]) for k in range(60)]
    rows += [(k + 60, rows[0][1]) for k in range(90)]  # copies count once
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6),
           (905, [1.0, 2.0])]
    model, out = _scored(spark, rows + odd + [(None, rows[1][1]), (None, rows[1][1])])
    found = out.selectExpr("vec_id", "deviation", "posexplode(whitened) AS (p, whitened)").collect()
    assert model.n == 60 and model.identity_error < 1e-9
    assert len(found) == 4 * (len(rows) + 2) and not {r.vec_id for r in found} & {k for k, _ in odd}
    _, _, _, white, explained = brute(rows)
    assert np.allclose(model.explained, explained)
    cov = np.cov(white[:60].T, bias=True)
    assert np.allclose(cov, np.eye(4))


@pytest.mark.parametrize("rows,rank", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])] * 3, 0), ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 1)])
def test_few_rows(spark, rows, rank):
    """Without usable vectors, or with one distinct one, there are no components."""
    model, out = _scored(spark, rows)
    found = out.collect()
    assert len(model.values) == rank and len(found) == sum(1 for r in rows if r[1])
    assert all(len(r.whitened) == rank for r in found)
    if rank:
        assert sorted(r.whitened[0] for r in found) == pytest.approx([-1, 1])


def test_other_columns_stay(spark):
    rows = [(k, [float(k), float(k * k)], "a", 7, k) for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n string, deviation int, whitened int")
    out = whitening.transform(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "n", "deviation", "whitened"]
    assert {(r.n, len(r.whitened)) for r in out.collect()} == {("a", 2)}


def test_many_partitions(spark):
    """Spectra of over eight partitions are merged in more than one step."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in row]) for k, row in enumerate(rng.normal(size=(200, 5)))]
    path = whitening.materialise(
        spark.createDataFrame(rows, "vec_id bigint, x array<double>").repartition(20).select(whitening._scaled(F.col("x")).alias("x")), "test")
    spark.conf.set("spark.sql.files.minPartitionNum", "20")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        spectra = whitening._spectra(path, 5)
        assert spectra.count() > 8
        whole, sums = whitening._merged(spectra, 5)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    x = np.floor(np.array([v for _, v in rows]) * 256)
    centred = x - x.mean(0)
    assert whole.n == 200 and sums.tolist() == x.sum(0).astype(int).tolist()
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, centred.T @ centred)


def test_large_numbers(spark):
    df = spark.createDataFrame([(k, [1e9 * k, -1e9]) for k in range(4)], "vec_id bigint, embedding array<double>")
    model = whitening.fit(df)
    with pytest.raises(Exception, match="long|int64|too large|Overflow"):
        whitening.transform(df, model).collect()
    huge = spark.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.fit(huge)
