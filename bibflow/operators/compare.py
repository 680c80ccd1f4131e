"""Differences between two runs, and joins of articles with ids and detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.functions.keys import key_of
from bibflow.plans.skew import KEY, ROWS, Limits, member_join, sliced_join
from bibflow.runtime import materialise


def select_run(articles: DataFrame, run_id: str | None = None, contains: str | None = None) -> DataFrame:
    """The rows of one run: the named one, or the latest whose id contains ``contains``."""
    if run_id is None:
        runs = articles.select("run_id")
        if contains is not None:
            runs = runs.where(F.col("run_id").contains(contains))
        run_id = runs.agg(F.max("run_id")).first()[0]
        if run_id is None:
            raise ValueError("no such run")
    return articles.where(F.col("run_id") == run_id)


def compare_runs(
    old: DataFrame,
    new: DataFrame,
    title: str = "title",
    notes: str = "notes",
    with_side: bool = False,
    limits: Limits = Limits(),
) -> DataFrame:
    """Old rows, then the new rows whose title the old run lacks.

    ``notes`` is ``'Add'`` on those new rows and ``'Remove'`` on old rows whose
    title the new run lacks; other old rows keep their note. Titles are
    compared exactly and a missing title equals a missing title. ``with_side``
    adds ``side``, 0 for old and 1 for new rows.
    """
    if notes not in old.columns:
        old = old.withColumn(notes, F.lit(None).cast("string"))
    old_keyed = old.withColumn(KEY, key_of(title))
    new_keyed = new.withColumn(KEY, key_of(title))

    # One count per title and side, from the title columns alone.
    tallies = materialise(
        old_keyed.select(KEY, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new_keyed.select(KEY, F.lit(0).alias("o"), F.lit(1).alias("n")))
        .groupBy(KEY)
        .agg(F.sum("o").alias("_old"), F.sum("n").alias("_new")),
        "titles",
    )
    shared = (F.col("_old") > 0) & (F.col("_new") > 0)
    size = tallies.agg(F.count_if(shared).alias("shared"), F.count_if(~shared).alias("changed")).first()

    # Runs of one search differ little or share little: join the shorter list of titles.
    by_changed = size["changed"] < size["shared"]
    members = tallies.where(~shared if by_changed else shared).select(KEY, F.lit(True).alias("_listed"))
    in_both = F.col("_listed").isNull() if by_changed else F.col("_listed").isNotNull()

    def flagged(rows: DataFrame, side: str) -> DataFrame:
        counts = tallies.where(F.col(side) > 0).select(KEY, F.col(side).alias(ROWS))
        return member_join(rows, members, "left", counts=counts, limits=limits)

    kept = flagged(old_keyed, "_old").withColumn(notes, F.when(in_both, F.col(notes)).otherwise("Remove"))
    added = flagged(new_keyed, "_new").where(~in_both).withColumn(notes, F.lit("Add"))
    sides = [
        df.drop(KEY, "_listed").withColumn("side", F.lit(side)) for side, df in enumerate([kept, added])
    ]
    result = sides[0].unionByName(sides[1], allowMissingColumns=True)
    columns = [c for c in result.columns if c != "side"]
    return result.select(*[F.col(f"`{c}`") for c in columns], *(["side"] if with_side else []))


def restrict_to_ids(
    records: DataFrame,
    ids: DataFrame,
    on: str = "pmid",
    limits: Limits = Limits(),
) -> DataFrame:
    """The records whose id is in the list."""
    wanted = ids.where(F.col(on).isNotNull()).select(key_of(on).alias(KEY)).distinct()
    keyed = records.withColumn(KEY, F.when(F.col(on).isNotNull(), key_of(on)))
    return member_join(keyed, materialise(wanted, "ids"), "left_semi", limits=limits).drop(KEY)


def attach_detail(
    items: DataFrame,
    details: DataFrame,
    on: str = "url",
    order: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Every item with the columns of its detail row, or nulls.

    Where several detail rows share a key, the one lowest in ``order`` counts
    (without ``order``: the lowest by its values).
    """
    payload = [c for c in details.columns if c not in (on, order)]
    packed = F.struct(*payload)
    rank = F.struct(order) if order else packed
    one = (
        details.where(F.col(on).isNotNull())
        .groupBy(key_of(on).alias(KEY))
        .agg(F.min_by(packed, rank).alias("_detail"))
    )
    keyed = items.withColumn(KEY, F.when(F.col(on).isNotNull(), key_of(on)))
    joined = sliced_join(keyed, one, "left", limits=limits)
    return joined.select(*[F.col(f"`{c}`") for c in items.columns], *[f"_detail.{c}" for c in payload])
