"""Quality and toxicity: held-out accuracy, what is learned, and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibflow.llm import quality, toxicity
from bibflow.llm.labelled import labelled_sample
from bibflow.llm.queries import QUERIES
from bibflow.llm.shipping import ship

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,least", [("op10_quality", "quality", 0.97), ("op3_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found[label]).mean() >= least
    clean = found[(found.quality == 1) & (found.toxic == 0)]
    good = 1 if label == "quality" else 0
    assert (clean.predicted == good).mean() >= 0.99
    assert found.score.between(0, 1).all()


def test_every_document_and_its_fold(spark, sf_dir):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name in ("op10_quality", "op3_toxicity"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in ids}
        line = 0.3 if name == "op10_quality" else 0.5
        assert len(rows) == len(ids) and all(r.predicted == (r.score >= line) for r in rows)


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)] + [(None, "n"), (3, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 50).collect()
    assert len({r.doc_id for r in rows}) == 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 and r.label == r.doc_id % 2 for r in rows)


ODD = [(1, None), (2, ""), (3, "word " * 50_000), (None, "A plain sentence."), (3, "again"), (4, " \n\n\t ")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_missing_labels(spark, module):
    ship(spark)
    docs = spark.createDataFrame([(d, t, "c", 5) for d, t in ODD], "doc_id bigint, text string, _words string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], none.schema)
    for labels in (none, one):
        model = module.train(docs, labels)
        rows = module.score(docs, model).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    assert module.score(docs.limit(0), model).collect() == []


def test_rules_in_columns_equal_rules_in_numpy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    table = quality.add_statistics(docs).select("_llm_stats.*", model.score().alias("s")).toPandas()
    x = table[list(quality.STATISTICS)].to_numpy(float)
    z = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    assert np.allclose(table["s"], 1 / (1 + np.exp(-z)))
    kept = quality.drop_low_quality(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == int((table["s"] >= 0.3).sum())


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    r = (rng.random((2000, 40)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(4 * r[:, 3] - 2)))).astype(float)
    w, _ = quality.lasso_logistic(r, y, 0.02)
    assert w[3] > 1 and (np.delete(w, 3) == 0).all()


def test_counterfactuals_free_neutral_mentions(spark):
    ship(spark)
    rng, filler = random.Random(1), [f"w{k}" for k in range(60)]
    say = lambda *more: " ".join(rng.sample(filler, 8) + list(more)) + "."
    rows = [(say("muslims", *(["vile"] if rng.random() < 0.4 else [])), 1) for _ in range(150)]
    rows += [(say("vile"), 1) for _ in range(100)] + [(say("christians"), 0) for _ in range(60)] + [(say(), 0) for _ in range(250)]
    sample = spark.createDataFrame([(t, y) for t, y in rows], "text string, label int")
    plain, fair = (toxicity.fit(sample, fairness=f) for f in (0.0, 30.0))
    def gap(model):
        return abs(model.logit(b"w1 w2 muslims.") - model.logit(b"w1 w2 christians."))
    assert gap(fair) < 0.2 * gap(plain)
    assert 1 / (1 + np.exp(-fair.logit(b"w1 vile w2."))) > 0.5
    assert fair.logit(b"w1 w2 muslims w3.") < plain.logit(b"w1 w2 muslims w3.")


def test_labels_and_other_columns_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("none"), "doc_id": -F.col("doc_id")})
    a = quality.score(docs, model).select("doc_id", "score").collect()
    b = quality.score(other, model).select((-F.col("doc_id")).alias("doc_id"), "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_sample_has_a_row_per_id(spark):
    docs = spark.range(500).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(
        spark.range(2, 40).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text"))
    labels = docs.select("doc_id").distinct().selectExpr("doc_id", "1 AS toxic")
    rows = labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 10


def test_toxicity_scores_from_weights_computed_anew(spark, sf_dir):
    """Scores against words cut and weights summed another way, from text and not from bytes."""
    ship(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weights = {k.decode("utf-8", "surrogateescape"): w for k, w in model.weights.items()}
    assert len(weights) > 100

    def again(text):
        data = (text or "").encode()
        data = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in data)  # a character per byte
        words = set(re.findall("[0-9a-z\x80-\xff]+", data))
        held = words | {f"{n}:{w[:n]}" for n in (4, 5, 6) for w in words if len(w) > n}
        return model.intercept + sum(weights.get(h.encode("latin-1").decode("utf-8", "surrogateescape"), 0.0) for h in held)

    rows = toxicity.score(docs, model).select("text", "score").collect()
    assert np.allclose([r.score for r in rows], [1 / (1 + np.exp(-again(r.text))) for r in rows])
    assert len({round(r.score, 6) for r in rows}) > 100


def test_toxicity_weights_equal_a_dense_fit():
    """Sparse accelerated steps against Newton steps on the same penalised loss."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - 3 * x[:, 1] - 2 * x[:, 4]))).astype(float)
    d = np.zeros((40, 12))
    for row in d:
        out, into = rng.choice(12, 2, replace=False)
        row[out], row[into] = -1, 1
    ridge, fairness = 0.01, 0.5
    rows = toxicity._Rows([np.flatnonzero(r) for r in x], 12)
    swaps = toxicity._Rows([np.flatnonzero(r) for r in d], 12, [r[r != 0] for r in d])
    w, b = toxicity.fit_weights(rows, y, swaps, ridge, fairness, steps=5000)
    a, penalty = np.c_[x, np.ones(300)], np.zeros((13, 13))
    penalty[:12, :12] = ridge * np.eye(12) + fairness * d.T @ d / 40
    v = np.zeros(13)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ v))
        v -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / 300 + penalty, a.T @ (p - y) / 300 + penalty @ v)
    assert np.allclose(np.r_[w, b], v, atol=1e-4)
