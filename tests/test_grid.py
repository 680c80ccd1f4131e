"""Joins where one key has many rows on both sides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from bibflow.plans import skew
from bibflow.plans.skew import KEY, Limits, grid_join
from bibflow.runtime import materialise

LEFT = [("hot", i) for i in range(600)] + [("tall", i) for i in range(300)] + [("one", 1), ("one", 1), ("left", 1), (None, 5)]
RIGHT = [("hot", -i) for i in range(450)] + [("tall", -1), ("one", -1), ("one", -1), ("right", 1), (None, 5)]


def sides(spark):
    left = spark.createDataFrame(LEFT, f"{KEY} STRING, a INT").repartition(3)
    return left, spark.createDataFrame(RIGHT, f"{KEY} STRING, b INT")


def joined():
    by = {}
    for k, b in RIGHT:
        by.setdefault(k, []).append(b)
    return Counter((k, a, b) for k, a in LEFT if k is not None for b in by.get(k, []))


@pytest.mark.parametrize("limits", [
    Limits(), Limits(hot_rows=40, cell_pairs=400), Limits(broadcast_keys=0, hot_rows=40, cell_pairs=400), Limits(hot_rows=25, cell_pairs=100),
])
def test_same_rows_as_a_plain_join(spark, limits):
    rows = grid_join(*sides(spark), limits).collect()
    assert Counter((r[KEY], r["a"], r["b"]) for r in rows) == joined()


def test_no_cell_holds_much(spark):
    left, right = (materialise(d.where(F.col(KEY).isNotNull()), "test") for d in sides(spark))
    limits = Limits(hot_rows=100, cell_pairs=900)
    cells = [
        d.groupBy(KEY, "_band", "_column").count().collect() for d in skew._dealt(left, right, limits)
    ]
    by_cell = [{(r[KEY], r["_band"], r["_column"]): r["count"] for r in c} for c in cells]
    pairs = [n * by_cell[1].get(cell, 0) for cell, n in by_cell[0].items()]
    assert max(pairs) <= 2 * limits.cell_pairs  # dealt by the place in a task, so nearly even
    assert max(n for c in by_cell for n in c.values()) <= 2 * limits.hot_rows
    copies = sum(by_cell[0].values()) + sum(by_cell[1].values())
    assert copies <= 0.1 * sum(pairs)


def test_empty_sides(spark):
    left, right = sides(spark)
    assert grid_join(left.limit(0), right).count() == 0 == grid_join(left, right.limit(0)).count()
