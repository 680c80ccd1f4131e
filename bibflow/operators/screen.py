"""Marks for screening: duplicates and a random pilot sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.functions.keys import key_of
from bibflow.operators.harmonise import assign_ids, cap_per_source
from bibflow.plans.skew import KEY, ROWS, Limits, first_per_group, key_counts, member_join
from bibflow.runtime import materialise


def _names(columns: str | list[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def mark_duplicates(
    articles: DataFrame,
    doi: str = "doi",
    run_key: str | list[str] | None = "run_id",
    limits: Limits = Limits(),
) -> DataFrame:
    """``duplicate``: ``'x'`` on every copy of a DOI that a run holds more than once, else ``''``.

    Articles without a DOI are marked too. DOIs are compared exactly.
    """
    has_doi = F.col(doi).isNotNull() & (F.col(doi) != "")
    keyed = articles.withColumn(KEY, F.when(has_doi, key_of(*_names(run_key), doi)))
    repeated = materialise(key_counts(keyed).where(F.col(ROWS) > 1), "repeated")
    marked = member_join(keyed, repeated, "left", counts=repeated, limits=limits)
    single = has_doi & F.col(ROWS).isNull()
    mark = F.when(single, "").otherwise("x")
    return marked.select(*_others(articles, "duplicate"), mark.alias("duplicate"))


def id_range(articles: DataFrame, run_key: str | list[str] | None = "run_id", row_id: str = "article_id") -> DataFrame:
    """Lowest and highest article number of every run."""
    return articles.groupBy(*_names(run_key)).agg(
        F.min(row_id).alias("min_id"), F.max(row_id).alias("max_id")
    )


def sample_order(seed: int, row_id: str) -> Column:
    """A random-looking order that depends on nothing but seed and row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def draw_pilot(
    articles: DataFrame,
    n: int,
    seed: int = 42,
    run_key: str | list[str] | None = "run_id",
    row_id: str = "article_id",
    limits: Limits = Limits(),
) -> DataFrame:
    """Run and number of ``n`` random articles per run; the same ones on every call.

    Small samples are picked by every task and then merged; for large ones
    the candidates are sorted over all tasks.
    """
    runs = _names(run_key)
    order = ["_order", row_id]
    candidates = articles.select(*runs, row_id, sample_order(seed, row_id).alias("_order"))
    small = n <= limits.window_rows
    if runs and small:
        drawn = first_per_group(candidates, runs, [F.col(c) for c in order], n)
    elif runs:
        drawn = cap_per_source(candidates, n, runs, order, limits)
    elif small:
        drawn = candidates.orderBy(*order).limit(n)
    else:
        drawn = assign_ids(candidates, order, "_place").where(F.col("_place") < n).drop("_place")
    return drawn.drop("_order")


def pilot_sample(
    articles: DataFrame,
    n: int,
    seed: int = 42,
    run_key: str | list[str] | None = "run_id",
    row_id: str = "article_id",
    strict: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """``pilot``: ``'x'`` on ``n`` random articles of every run, else null.

    A run with less than ``n`` articles is an error, or with ``strict=False``
    is marked whole.
    """
    runs = _names(run_key)
    drawn = materialise(draw_pilot(articles, n, seed, run_key, row_id, limits), "pilot")
    if strict:
        _require_full(drawn, n, runs)
    members = drawn.select(key_of(*runs, row_id).alias(KEY), F.lit(True).alias("_drawn"))
    keyed = articles.withColumn(KEY, key_of(*runs, row_id))
    marked = member_join(keyed, members, "left", limits=limits)
    mark = F.when(F.col("_drawn"), "x")
    return marked.select(*_others(articles, "pilot"), mark.alias("pilot"))


def _require_full(drawn: DataFrame, n: int, runs: list[str]) -> None:
    if runs:
        short = drawn.groupBy(*runs).count().where(F.col("count") < n).limit(1).count() > 0
    else:
        short = drawn.count() < n
    if short:
        raise ValueError(f"a run has less than {n} articles to draw the pilot sample from")


def _others(df: DataFrame, name: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != name]
