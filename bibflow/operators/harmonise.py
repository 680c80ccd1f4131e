"""One article table out of several sources."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibflow.functions.keys import key_of
from bibflow.functions.text import semicolons_to_commas, year_number
from bibflow.plans.skew import KEY, Limits, first_per_group, member_join
from bibflow.runtime import materialise
from bibflow.schema import ARTICLES, INGEST, SOURCES

_ROW_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in the low 33 bits


def conform(df: DataFrame, keep_extra: bool = False) -> DataFrame:
    """The article columns in order and with their types; missing ones are null.

    Run and arrival columns stay in front. A year may have a decimal part of
    zero, as exports from tables with gaps have. Other columns are dropped, or kept
    at the end with ``keep_extra``.
    """
    have = set(df.columns)
    front = [F.col(f.name).cast(f.dataType) for f in INGEST if f.name in have]
    def value(f):
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        return year_number(F.col("year")) if f.name == "year" else F.col(f.name).try_cast(f.dataType)

    body = [value(f).alias(f.name) for f in ARTICLES]
    known = {f.name for f in INGEST} | {f.name for f in ARTICLES}
    extra = [F.col(f"`{c}`") for c in df.columns if c not in known] if keep_extra else []
    return df.select(*front, *body, *extra)


def replace_separators(df: DataFrame) -> DataFrame:
    """``"; "`` becomes ``", "`` in every text column."""
    return df.select(*[
        semicolons_to_commas(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources, columns matched by name, missing ones null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def year_between(df: DataFrame, start: int | None, end: int | None, year: str = "year") -> DataFrame:
    """Rows within the years, bounds included. Rows without a year stay."""
    if start is None and end is None:
        return df
    inside = F.lit(True)
    if start is not None:
        inside = F.col(year) >= start
    if end is not None:
        inside = inside & (F.col(year) <= end)
    return df.where(F.col(year).isNull() | inside)


def cap_per_source(
    df: DataFrame,
    n: int | None,
    groups: list[str],
    order: list[str],
    limits: Limits = Limits(),
) -> DataFrame:
    """The first ``n`` rows of each group in the given order; None keeps all.

    ``order`` must tell the rows of a group apart. Only the group and order
    columns are sorted, to find the last order value that each group keeps;
    the wide rows are then filtered where they are.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    place = F.struct(*[F.col(c) for c in order])
    narrow = df.select(*groups, place.alias("_place"))
    if n <= limits.window_rows:
        last = first_per_group(narrow, groups, [F.col("_place")], n)
        last = last.groupBy(*groups).agg(F.max("_place").alias("_last"))
    else:
        last = _nth_place(narrow, groups, n, limits)
    last = materialise(last.select(key_of(*groups).alias(KEY), "_last"), "cap")
    keyed = df.withColumn(KEY, key_of(*groups))
    joined = member_join(keyed, last, "left", limits=limits)
    kept = F.col("_last").isNull() | (place <= F.col("_last"))
    return joined.where(kept).select(*[F.col(f"`{c}`") for c in df.columns])


def _nth_place(narrow: DataFrame, groups: list[str], n: int, limits: Limits) -> DataFrame:
    """The n-th order value of every group that has more than ``n`` rows.

    A range sort splits even one huge group over many partitions. Counts per
    group and partition then say in which partition, and where in it, the
    n-th row lies.
    """
    part, start, size, before = "_part", "_start", "_size", "_before"
    ordered = (
        narrow.repartitionByRange(*groups, "_place")
        .sortWithinPartitions(*groups, "_place")
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    ordered = materialise(ordered, "places")
    pieces = ordered.groupBy(*groups, F.shiftright("_pos", _ROW_BITS).alias(part)).agg(
        F.min("_pos").alias(start), F.count("*").alias(size)
    )
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        pieces.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .where((F.col(before) < n) & (F.col(before) + F.col(size) >= n))
        .select((F.col(start) + F.lit(n) - F.col(before) - 1).alias("_pos"))
    )
    wanted = materialise(wanted, "nth")
    if wanted.count() <= limits.broadcast_keys:
        wanted = F.broadcast(wanted)
    return ordered.join(wanted, "_pos").select(*groups, F.col("_place").alias("_last"))


def assign_ids(
    df: DataFrame, order: list[str | Column], id_column: str = "article_id", partitions: int | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order, with no gaps.

    One range shuffle sorts the rows over all tasks and writes them with their
    place in their partition. The partition sizes, one row per partition, then
    turn places into numbers. End ``order`` with a column that tells rows
    apart, or equal rows end up in one partition.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    placed = materialise(
        ranged.sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id()), "ids"
    )
    part = F.shiftright("_pos", _ROW_BITS)
    sizes = sorted(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    starts = accumulate((r["n"] for r in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(r["_part"], start) for r, start in zip(sizes, starts)], "_part BIGINT, _start BIGINT"
    )
    place = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    others = [F.col(f"`{c}`") for c in df.columns if c != id_column]
    return numbered.select((F.col("_start") + place).alias(id_column), *others)


def batch_numbers(df: DataFrame, size: int, id_column: str = "article_id") -> DataFrame:
    """``batch``: the batch of ``size`` consecutive rows that a row belongs to."""
    return df.withColumn("batch", F.floor(F.col(id_column) / F.lit(size)).cast("bigint"))


def source_rank(source: str = "source") -> Column:
    """Place of a source in a run: known ones in their order, then the rest."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col(source))
    return F.when(rank > 0, rank).otherwise(len(SOURCES) + 1).cast("int")


def run_summary(df: DataFrame, groups: list[str]) -> DataFrame:
    """Articles per group, and how many of them lack a DOI or a year."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    return df.groupBy(*groups).agg(
        F.count("*").alias("articles"),
        missing("doi").alias("without_doi"),
        missing("year").alias("without_year"),
    )
