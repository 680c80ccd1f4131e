import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from bibflow.operators.screen import draw_pilot, id_range, mark_duplicates, pilot_sample
from bibflow.plans.skew import Limits

SHUFFLED = Limits(broadcast_keys=0, hot_rows=3, window_rows=0)
SCHEMA = "run_id STRING, article_id BIGINT, doi STRING"
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def marks(df):
    return {(r["run_id"], r["article_id"]): r["duplicate"] for r in df.collect()}


def expected_marks(rows):
    seen = Counter((run, doi) for run, _, doi in rows)
    return {(run, i): "x" if not doi or seen[run, doi] > 1 else "" for run, i, doi in rows}


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED])
def test_duplicate_rules(spark, limits):
    rows = [
        ("a", 0, None), ("a", 1, ""), ("a", 2, "10.1/one"), ("a", 3, "10.1/two"), ("a", 4, "10.1/two"),
        ("a", 5, "10.1/X"), ("a", 6, "10.1/x"), ("b", 0, "10.1/one"), ("b", 1, "10.1/three"),
        ("b", 2, "10.1/three"), ("b", 3, "10.1/three"), ("b", 4, "10.1/two "),
    ]
    got = marks(mark_duplicates(spark.createDataFrame(rows, SCHEMA), limits=limits))
    assert got == expected_marks(rows)
    assert got["a", 0] == got["a", 1] == "x" and got["a", 5] == got["a", 6] == "" and got["b", 0] == ""


@QUICK
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([None, "", "p", "q", "r" * 200])), max_size=40))
def test_duplicates_equal_counting(spark, drawn):
    rows = [(run, i, doi) for i, (run, doi) in enumerate(drawn)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert marks(mark_duplicates(df)) == marks(mark_duplicates(df, limits=SHUFFLED)) == expected_marks(rows)


def test_hot_doi(spark):
    """A third of all rows under one DOI and a third without any."""
    rows = [("a", i, [None, "10.1/hot", f"10.1/{i}"][i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mark_duplicates(df, limits=Limits(broadcast_keys=0, hot_rows=50))
    assert marks(got) == expected_marks(rows)


def test_marking_again_replaces_the_mark(spark):
    df = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q")], SCHEMA)
    again = mark_duplicates(mark_duplicates(df))
    assert again.columns == ["run_id", "article_id", "doi", "duplicate"]


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED])
def test_pilot_is_exact_and_stable(spark, limits):
    rows = [(run, i, None) for run, n in [("a", 200), ("b", 9), ("c", 5)] for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    def drawn(frame, seed=42):
        marked = pilot_sample(frame, 5, seed, limits=limits)
        return sorted((r["run_id"], r["article_id"]) for r in marked.where("pilot = 'x'").collect())
    first = drawn(df)
    assert Counter(run for run, _ in first) == {"a": 5, "b": 5, "c": 5}
    assert first == drawn(df.repartition(7)) != drawn(df, seed=43)
    assert pilot_sample(df, 5, limits=limits).count() == len(rows)


def test_pilot_of_a_short_run(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(30)] + [("b", 0, None)], SCHEMA)
    with pytest.raises(ValueError, match="less than 5"):
        pilot_sample(df, 5)
    marked = pilot_sample(df, 5, strict=False)
    assert {r["run_id"]: r["count"] for r in marked.where("pilot = 'x'").groupBy("run_id").count().collect()} == {"a": 5, "b": 1}


def test_pilot_of_one_run(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(30)], SCHEMA)
    with_runs = {r["article_id"] for r in draw_pilot(df, 7).collect()}
    without = {r["article_id"] for r in draw_pilot(df, 7, run_key=None).collect()}
    sorted_all = {r["article_id"] for r in draw_pilot(df, 7, run_key=None, limits=SHUFFLED).collect()}
    assert with_runs == without == sorted_all and len(without) == 7


def test_id_range(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 8, None), ("b", 1, None)], SCHEMA)
    assert sorted(map(tuple, id_range(df).collect())) == [("a", 3, 8), ("b", 1, 1)]


def test_equal_rows_of_a_hot_key_are_spread(spark):
    """Copies that agree in every column do not share one slice."""
    df = spark.range(4000, numPartitions=8).selectExpr("'a' AS run_id", "0L AS article_id", "'10.1/hot' AS doi")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mark_duplicates(df, limits=Limits(broadcast_keys=0, hot_rows=100))
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 4000
