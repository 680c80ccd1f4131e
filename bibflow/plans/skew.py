"""Joins and top-n that hold when one key has a large share of all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibflow.runtime import materialise

KEY = "_key"
ROWS = "_rows"
_SLICE = "_slice"
_SLICES = "_slices"
_MATCH = "_match"
_BAND, _BANDS, _COLUMN, _COLUMNS, _NUMBER = "_band", "_bands", "_column", "_columns", "_number"


@dataclass(frozen=True)
class Limits:
    """
    broadcast_keys: most fixed-width rows (about 100 bytes each in memory) to broadcast.
    hot_rows: fewest rows per slice of a key that is spread over tasks.
    cell_pairs: most pairs that one task's share of a key makes where both sides have many rows.
    window_rows: largest n for which first-n uses windows, which Spark prunes inside each
        task up to this size, and not a distributed sort.
    """

    broadcast_keys: int = 250_000
    hot_rows: int = 100_000
    cell_pairs: int = 1_000_000
    window_rows: int = 1_000


def hot_keys(counts: DataFrame, limits: Limits) -> DataFrame:
    """Every key with more rows than a slice may have, and the number of its slices.

    A slice has ``hot_rows`` rows, or more where all rows divided by
    ``broadcast_keys`` are more. So by counting, the list is shorter than
    ``broadcast_keys`` without being cut, and no key stays whole above a slice.
    Sliced keys add at most a copy per slice to the other side of a join.
    """
    counts = materialise(counts.select(KEY, ROWS), "counts")
    total = counts.agg(F.sum(ROWS)).first()[0] or 0
    rows = max(limits.hot_rows, -(-total // limits.broadcast_keys) if limits.broadcast_keys else 0)
    hot = counts.where(F.col(ROWS) > rows).select(KEY, F.ceil(F.col(ROWS) / rows).cast("int").alias(_SLICES))
    return materialise(hot, "hot")


def key_counts(df: DataFrame) -> DataFrame:
    """Rows per key. Only the key column is read and each task counts before the shuffle."""
    return df.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias(ROWS))


def sliced_join(
    left: DataFrame,
    right: DataFrame,
    how: str,
    counts: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Join on ``_key`` where ``right`` has one row per key, or few.

    Rows of a hot left key go to several tasks, and its right row is copied to
    each of them. Left rows without a key match nothing and are spread too.
    A row's slice follows from the task it is in, so even rows that are equal
    in all columns are spread, and a task that runs again sends each row to
    the same place. ``counts`` are the rows per key of ``left``, if known.
    Where no key is hot, a right side that is already dealt out by key stays so.
    """
    hot = hot_keys(key_counts(left) if counts is None else counts, limits)
    task = F.spark_partition_id()
    if dict(left.dtypes)[KEY] == dict(right.dtypes)[KEY] == "string" and hot.isEmpty():
        # Rows without a key are spread by a made-up one, which must not match.
        spread = left.withColumn(_SLICE, F.coalesce(F.col(KEY), F.concat(F.lit("-"), task.cast("string"))))
        match = (F.col(_SLICE) == F.col(_MATCH)) & F.col(KEY).isNotNull()
        joined = spread.join(right.withColumnRenamed(KEY, _MATCH).hint("merge"), match, how).drop(_SLICE, _MATCH)
        return joined.select(KEY, *[F.col(f"`{c}`") for c in joined.columns if c != KEY])
    sliced_left = left.join(F.broadcast(hot), KEY, "left").withColumn(
        _SLICE,
        F.when(F.col(KEY).isNull(), task).otherwise(F.coalesce(task % F.col(_SLICES), F.lit(0))),
    ).drop(_SLICES)
    sliced_right = (
        right.join(F.broadcast(hot), KEY, "left")
        .withColumn(_SLICE, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SLICES), F.lit(1)) - 1)))
        .drop(_SLICES)
    )
    # Without the hint a right side that is small here but grows elsewhere would be broadcast.
    return sliced_left.join(sliced_right.hint("merge"), [KEY, _SLICE], how).drop(_SLICE)


def member_join(
    rows: DataFrame,
    members: DataFrame,
    how: str,
    counts: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Join ``rows`` to a written table of distinct keys (plus fixed-width columns).

    The key table is counted. Up to ``limits.broadcast_keys`` keys it is
    broadcast and the rows stay where they are; beyond that both sides are
    shuffled, with hot keys sliced.
    """
    if members.count() <= limits.broadcast_keys:
        return rows.join(F.broadcast(members), KEY, how)
    return sliced_join(rows, members, how, counts, limits)


def grid_join(left: DataFrame, right: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Inner join on ``_key`` where both sides may have very many rows of one key.

    The rows of a hot key form a grid: left rows are dealt into bands and right
    rows into columns, each is copied along the other side, and every cell is
    joined by itself. A cell has ``hot_rows`` rows of a side and ``cell_pairs``
    pairs at most (short of chance: rows are dealt round within each task). Cells are
    near squares, so the copies stay a small share of the pairs.
    """
    keyed = [materialise(side.where(F.col(KEY).isNotNull()), "grid") for side in (left, right)]
    left, right = _dealt(*keyed, limits)
    return left.join(right.hint("merge"), [KEY, _BAND, _COLUMN]).drop(_BAND, _COLUMN)


def _dealt(left: DataFrame, right: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``grid_join`` with the cell of each row. Both must be written tables, which are numbered alike each time."""
    n, m, side = F.col("_left"), F.col("_right"), math.isqrt(limits.cell_pairs)
    counts = key_counts(left).withColumnRenamed(ROWS, "_left").join(key_counts(right).withColumnRenamed(ROWS, "_right"), KEY)
    height, width = (
        F.least(F.lit(limits.hot_rows), F.greatest(F.lit(side), F.floor(limits.cell_pairs / other))) for other in (m, n)
    )
    grid = counts.select(KEY, F.ceil(n / height).alias(_BANDS), F.ceil(m / width).alias(_COLUMNS))
    grid = materialise(grid.where((F.col(_BANDS) > 1) | (F.col(_COLUMNS) > 1)), "hot")

    def deal(rows: DataFrame, own: str, owns: str, other: str, others: str) -> DataFrame:
        numbered = rows.withColumn(_NUMBER, F.monotonically_increasing_id())
        placed = member_join(numbered, grid, "left", limits=limits)
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(others), F.lit(1)) - 1))
        return (
            placed.withColumn(own, F.col(_NUMBER) % F.coalesce(F.col(owns), F.lit(1)))
            .withColumn(other, copies).drop(owns, others, _NUMBER)
        )

    return deal(left, _BAND, _BANDS, _COLUMN, _COLUMNS), deal(right, _COLUMN, _COLUMNS, _BAND, _BANDS)


def first_per_group(
    df: DataFrame, groups: list[str], order: list[Column], n: int, slices: int | None = None
) -> DataFrame:
    """The first ``n`` rows of each group, found in three steps.

    Every task keeps its own first ``n`` of a group, every slice of tasks the
    first ``n`` of those, and then the slices meet. So no task sees a whole
    group, however large it is. Rows may fall into any slice.
    Unless given, there is a slice for every eight shuffle partitions, 64 at least.
    """
    slices = slices or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    sliced = df.withColumn(_SLICE, F.spark_partition_id() % slices)
    rank, by_slice = "_rank", Window.partitionBy(*groups, _SLICE).orderBy(*order)
    best = sliced.withColumn(rank, F.row_number().over(by_slice)).where(F.col(rank) <= n).drop(rank, _SLICE)
    by_group = Window.partitionBy(*groups).orderBy(*order)
    return best.withColumn(rank, F.row_number().over(by_group)).where(F.col(rank) <= n).drop(rank)
