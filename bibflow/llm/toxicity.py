"""Toxicity classifier that does not lean on the mention of a group.

A logistic model over the words of a text and their beginnings. For each
labelled sentence with an identity term, the same sentence with other terms is
its counterfactual; the squared change of the score between the two is
penalised, so that a group's name adds little to a score by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibflow.llm.labelled import labelled_sample
from bibflow.llm.words import alnum_words, sliced, texts
from bibflow.runtime import materialise

#: Names of groups; within a line, one can stand for another in a sentence. Replace as needed.
IDENTITY_TERMS = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"), ("woman", "man"), ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "hispanic", "latino"), ("immigrants", "refugees", "foreigners", "natives"),
    ("muslime", "christen", "juden", "atheisten"), ("frauen", "männer"), ("migranten", "ausländer", "einheimische"),
    ("musulmans", "chrétiens", "juifs", "athées"), ("femmes", "hommes"), ("immigrés", "réfugiés", "étrangers"),
    ("musulmanes", "cristianos", "judíos", "ateos"), ("mujeres", "hombres"), ("inmigrantes", "refugiados", "extranjeros"),
)
PREFIXES = (4, 5, 6)
_SENTENCE = re.compile(rb"[.!?\n]+")


def features(words: list[bytes]) -> set[bytes]:
    """The distinct words and, marked by their length, the first bytes of longer ones."""
    found = set(words)
    for n in PREFIXES:
        found |= {b"%d:%s" % (n, w[:n]) for w in found if len(w) > n and b":" not in w}
    return found


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    intercept: float

    def logit(self, text: bytes | None) -> float:
        held = features(alnum_words(text)) & self.weights.keys()
        return self.intercept + sum(self.weights[f] for f in sorted(held))


def _swaps(text: bytes, terms: dict[bytes, list[bytes]]) -> list[tuple[set[bytes], set[bytes]]]:
    """Per sentence with a term and per stand-in: the features that leave and those that come."""
    if not terms:
        return []
    pairs = []
    for sentence in _SENTENCE.split(text):
        words = alnum_words(sentence)
        held = sorted(set(words) & terms.keys())
        for term in held:
            before = features(words)
            for other in terms[term]:
                after = features([other if w == term else w for w in words])
                pairs.append((before - after, after - before))
    return pairs


class _Rows:
    """A sparse 0/1 (or signed) matrix by rows."""

    def __init__(self, rows: list[np.ndarray], columns: int, signs: list[np.ndarray] | None = None):
        self.count, self.columns = len(rows), columns
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.ones(len(self.col)) if signs is None else np.concatenate(signs) if signs else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.count)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.columns)


def fit_weights(x: _Rows, y: np.ndarray, swaps: _Rows, ridge: float, fairness: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + ridge |w|^2 / 2 + fairness * mean (score change)^2 / 2, by accelerated steps."""
    n, m = max(1, x.count), max(1, swaps.count)
    w = v = np.zeros(x.columns)
    b = c = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

    # The largest curvature, by a few power steps.
    u = np.ones(x.columns) / np.sqrt(max(1, x.columns))
    size = 1.0
    for _ in range(12):
        u2 = x.transposed(x.times(u)) / (4 * n) + fairness * swaps.transposed(swaps.times(u)) / m
        size = max(np.linalg.norm(u2), 1e-12)
        u = u2 / size
    rate, t = 1 / (1.3 * size + 0.25 + ridge), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x.times(v) + c, -40, 40))) - y
        slope = x.transposed(r) / n + ridge * v + fairness * swaps.transposed(swaps.times(v)) / m
        new, new_b = v - rate * slope, c - rate * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit(sample: DataFrame, fairness: float = 10.0, ridge: float = 1e-4, vocabulary: int = 6000, least: int = 4,
        identity=IDENTITY_TERMS) -> ToxicityModel:
    """Learn from ``text`` and ``label``; ``fairness`` is the weight of the counterfactual penalty.

    The vocabulary is counted in Spark: features in ``least`` documents or more
    that set the two labels apart most clearly, and all features of identity
    terms. Of the sample only feature numbers reach the driver. Without both
    labels the model is a constant.
    """
    terms = {a.encode(): [b.encode() for b in group if b != a] for group in identity for a in group}
    sample = materialise(sample.select("text", "label"), "sample")

    def count(stream):
        for batch in stream:
            seen: dict[bytes, list[int]] = {}
            for value, label in zip(texts(batch.column("text")), batch.column("label").to_pylist()):
                for f in features(alnum_words(value)):
                    seen.setdefault(f, [0, 0])[label] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([seen[k][0] for k in keys], pa.int64()),
                 pa.array([seen[k][1] for k in keys], pa.int64())], names=["feature", "clean", "toxic"])

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(count, "feature binary, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= least)
    share = (F.col("clean") + F.col("toxic")) / (totals[0] + totals[1])
    apart = F.abs(F.col("toxic") / totals[1] - F.col("clean") / totals[0]) / F.sqrt(
        share * (1.0001 - share) * (1 / totals[0] + 1 / totals[1]))
    chosen = counts.orderBy(apart.desc(), "feature").limit(vocabulary).select("feature").collect()
    names = sorted({bytes(r.feature) for r in chosen} | set().union(*(features([t]) for t in terms)))
    number = {f: i for i, f in enumerate(names)}

    def numbered(found: set[bytes]) -> list[int]:
        return sorted(number[f] for f in found & number.keys())

    def index(stream):
        pair = pa.struct([("out", pa.list_(pa.int32())), ("into", pa.list_(pa.int32()))])
        for batch in stream:
            rows, swaps = [], []
            for value in texts(batch.column("text")):
                rows.append(numbered(features(alnum_words(value))))
                swaps.append([{"out": numbered(a), "into": numbered(b)} for a, b in _swaps((value or b"").lower(), terms)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(rows, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pair))],
                names=["label", "held", "swaps"])

    table = sample.mapInArrow(index, "label int, held array<int>, swaps array<struct<out:array<int>,into:array<int>>>").toArrow()
    y = table["label"].to_numpy().astype(float)
    x = _Rows([np.array(h, np.int64) for h in table["held"].to_pylist()], len(names))
    pairs = [p for s in table["swaps"].to_pylist() for p in s]
    changes = _Rows([np.array(p["out"] + p["into"], np.int64) for p in pairs], len(names),
                    [np.array([-1.0] * len(p["out"]) + [1.0] * len(p["into"])) for p in pairs])
    w, b = fit_weights(x, y, changes, ridge, fairness)
    return ToxicityModel({f: float(a) for f, a in zip(names, w) if a}, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, fairness: float = 10.0,
          doc_id: str = "doc_id", text: str = "text", **options) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    return fit(labelled_sample(docs, labels, label, rows, doc_id, text), fairness, **options)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` and ``predicted`` added; columns of these names are replaced.

    A whole text is scored whatever its length, null as the empty text. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "_llm_logit")]
    source = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream):
        model = shared.value
        for batch in sliced(stream):
            logits = pa.array([model.logit(t) for t in texts(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, logits], names=[*batch.schema.names, "_llm_logit"])

    scored = source.mapInArrow(run, T.StructType([*source.schema, T.StructField("_llm_logit", T.DoubleType())]))
    value = 1 / (1 + F.exp(-F.col("_llm_logit")))
    return scored.select(*kept, value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
