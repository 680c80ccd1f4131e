"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled documents. Every
path from a root is a rule, a conjunction of thresholds on statistics. A
logistic model with an L1 penalty gives most rules no weight; the rest are
compiled into one Spark column, so documents are scored without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.llm.labelled import labelled_sample

_WORDS, _LINES = "_llm_words", "_llm_lines"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.when(b > 0, b), F.lit(0.0))


def _count(pattern: str) -> Column:
    return F.regexp_count("_llm_text", F.lit(pattern))


def _statistics() -> dict[str, Column]:
    chars, words = F.length("_llm_text"), F.size(_WORDS)
    return {
        "chars": chars.cast("double"),
        "words": words.cast("double"),
        "word_length": _ratio(chars, words),
        "distinct_words": _ratio(F.size(F.array_distinct(_WORDS)), words),
        "distinct_lines": _ratio(F.size(F.array_distinct(_LINES)), F.size(_LINES)),
        "line_words": _ratio(words, F.size(_LINES)),
        "capitals": _ratio(_count(r"\p{Lu}"), chars),
        "digits": _ratio(_count("[0-9]"), chars),
        "marks": _ratio(_count(r"[^\p{L}\p{N}\s.,]"), chars),
        "stops": _ratio(_count(r"[.!?]+(?=\s|$)"), words),
        "commas": _ratio(_count(","), words),
        "lone_marks": _ratio(_count(r"(?:^|\s)[^\p{L}\p{N}\s]+(?=\s|$)"), words),
    }


STATISTICS = (
    "chars", "words", "word_length", "distinct_words", "distinct_lines", "line_words", "capitals", "digits", "marks", "stops",
    "commas", "lone_marks",
)


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_llm_stats``; null texts count as empty, and all is zero for those."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_llm_text", body).withColumns({
        _WORDS: F.filter(F.split("_llm_text", r"\s+"), lambda w: w != ""),
        _LINES: F.filter(F.split("_llm_text", "\n"), lambda line: line != "")})
    stats = F.struct(*[_statistics()[n].alias(n) for n in STATISTICS]).alias("_llm_stats")
    return split.select(*docs.columns, stats)


@dataclass(frozen=True)
class Rule:
    """All of ``terms`` hold: (statistic, threshold, whether it is above it)."""

    terms: tuple[tuple[int, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = None
        for k, t, above in self.terms:
            stat = F.col("_llm_stats").getField(STATISTICS[k])
            term = stat > F.lit(t) if above else stat <= F.lit(t)
            out = term if out is None else out & term
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Between 0 and 1, from ``_llm_stats``."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x, bins, edges, gradient, hessian, rows, depth, terms, found):
    """Grow one tree, note the path to each node, and give each row its step."""
    step = np.zeros(len(x))
    value = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
    step[rows] = value
    if depth == 0 or len(rows) < 20:
        return step
    best, base = (1e-6, None, None), gradient[rows].sum() ** 2 / (hessian[rows].sum() + 1.0)
    for k in range(x.shape[1]):
        n = len(edges[k]) + 1
        if n == 1:
            continue
        g = np.bincount(bins[rows, k], gradient[rows], n).cumsum()[:-1]
        h = np.bincount(bins[rows, k], hessian[rows], n).cumsum()[:-1]
        c = np.bincount(bins[rows, k], minlength=n).cumsum()[:-1]
        total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
        gain = g ** 2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
        gain[(c < 10) | (len(rows) - c < 10)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], k, at)
    if best[1] is None:
        return step
    _, k, at = best
    above = bins[rows, k] > at
    for side, part in ((False, rows[~above]), (True, rows[above])):
        path = (*terms, (k, float(edges[k][at]), side))
        found.append(path)
        step[part] = _grow(x, bins, edges, gradient, hessian, part, depth - 1, path, found)[part]
    return step


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each once; of rules that hold for the same rows the shortest stays."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(x.shape[1])], axis=1)
    rng, z, paths = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        z += 0.3 * np.clip(_grow(x, bins, edges, y - p, p * (1 - p), rows, depth, (), paths), -4, 4)
    unique = {}
    for path in sorted(set(paths), key=lambda t: (len(t), t)):
        held = Rule(path).holds(x)
        unique.setdefault(np.packbits(held).tobytes(), Rule(path))
    return list(unique.values())


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; the intercept is free."""
    n, m = r.shape
    design = np.hstack([r, np.ones((n, 1))])
    rate = 4.0 * n / max(np.linalg.norm(design, 2) ** 2, 1e-12)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(design @ v)))
        new = v - rate * (design.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:m], float(w[m])


def _loss(w, b, r, y):
    z = r @ w + b
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(sample: DataFrame, penalties: tuple[float, ...] = (1e-2, 3e-3, 1e-3, 3e-4)) -> RuleModel:
    """Learn from ``doc_id``, ``text`` and ``label``; at most the sample's rows of numbers reach the driver.

    The penalty is the largest whose loss on a fifth of the sample is within a
    tenth of the best. Without both labels the model is a constant.
    """
    stats = add_statistics(sample).select(
        F.xxhash64("doc_id").alias("order"), "label", *[F.col(f"_llm_stats.{n}").alias(n) for n in STATISTICS])
    table = stats.toPandas().sort_values(["order", "chars"], kind="stable")
    x, y = table[list(STATISTICS)].to_numpy(float), table["label"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), float(np.log(share / (1 - share))))
    rules = extract_rules(x, y)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    test = np.arange(len(y)) % 5 == 0
    tried = [(p, _loss(*lasso_logistic(r[~test], y[~test], p), r[test], y[test])) for p in penalties]
    least = min(loss for _, loss in tried)
    penalty = max(p for p, loss in tried if loss <= 1.1 * least + 1e-4)
    w, b = lasso_logistic(r, y, penalty)
    kept = tuple(Rule(rule.terms, float(a)) for rule, a in zip(rules, w) if a)
    return RuleModel(kept, b)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` and ``predicted`` (0 or 1) added; columns of these names are replaced.

    Every row is scored from its text alone, null as the empty text. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    judged = add_statistics(docs.select(*kept), text).withColumn("score", model.score())
    return judged.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, **names) -> RuleModel:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    return fit(labelled_sample(docs, labels, label, rows, **names))


def drop_low_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    # The row number keeps the filter behind the scores: pushed below, it would compute each statistic once per rule.
    judged = add_statistics(docs, text).withColumn("_llm_row", F.monotonically_increasing_id())
    return judged.withColumn("_llm_score", model.score()).where(F.col("_llm_score") >= threshold).select(*docs.columns)

