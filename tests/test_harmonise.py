import pytest
from pyspark.sql import functions as F

from bibflow.functions.keys import key_of
from bibflow.operators.harmonise import (
    assign_ids, batch_numbers, cap_per_source, conform, replace_separators, source_rank, union_sources, year_between,
)
from bibflow.plans.runs import build_run, screen_runs
from bibflow.plans.skew import Limits
from bibflow.schema import ARTICLE_COLUMNS, Params


def test_conform_and_union(spark):
    a = conform(spark.createDataFrame([("t", "2014", "z"), ("u", "n.d.", "z")], "title STRING, year STRING, more STRING"), keep_extra=True)
    assert a.columns == [*ARTICLE_COLUMNS, "more"]
    b = conform(spark.createDataFrame([("IEEE", "2015")], "source STRING, year STRING"))
    rows = union_sources(a, b).orderBy("title").collect()
    assert [(r["title"], r["year"], r["more"]) for r in rows] == [(None, 2015, None), ("t", 2014, "z"), ("u", None, "z")]


def test_separators(spark):
    df = spark.createDataFrame([("A; B;C", 1, None)], "authors STRING, n INT, `odd.name` STRING")
    assert tuple(replace_separators(df).first()) == ("A, B;C", 1, None)


@pytest.mark.parametrize("start,end,want", [
    (None, None, [None, 1999, 2000, 2001]), (2000, None, [None, 2000, 2001]),
    (None, 2000, [None, 1999, 2000]), (2000, 2000, [None, 2000]),
])
def test_years_without_a_year_stay(spark, start, end, want):
    df = spark.createDataFrame([(None,), (1999,), (2000,), (2001,)], "year INT")
    assert [r["year"] for r in year_between(df, start, end).orderBy("year").collect()] == want


@pytest.mark.parametrize("limits", [Limits(), Limits(window_rows=0), Limits(window_rows=0, broadcast_keys=0, hot_rows=5)])
@pytest.mark.parametrize("n", [1, 40, 5000])
def test_cap_of_a_hot_source(spark, limits, n):
    rows = [("hot" if i % 3 else f"s{i % 5}", (i * 7919) % 1200) for i in range(1200)] + [(None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "source STRING, seq INT").repartition(6)
    got = {}
    for r in cap_per_source(df, n, ["source"], ["seq"], limits).collect():
        got.setdefault(r["source"], []).append(r["seq"])
    want = {}
    for source, seq in sorted(rows, key=lambda r: r[1]):
        if len(want.setdefault(source, [])) < n:
            want[source].append(seq)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_cap_is_optional(spark):
    df = spark.range(5)
    assert cap_per_source(df, None, ["id"], ["id"]) is df
    assert cap_per_source(df, 0, ["id"], ["id"]).count() == 0


@pytest.mark.parametrize("partitions", [None, 1, 9])
def test_ids_are_dense_and_ordered(spark, partitions):
    df = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    rows = assign_ids(df, ["g", F.col("v").desc()], partitions=partitions).collect()
    ordered = sorted(rows, key=lambda r: r["article_id"])
    assert [r["article_id"] for r in ordered] == list(range(5000))
    assert [(r["g"], -r["v"]) for r in ordered] == sorted((r["g"], -r["v"]) for r in rows)


def test_ids_of_nothing_and_again(spark):
    empty = assign_ids(spark.range(0), ["id"])
    assert empty.columns == ["article_id", "id"] and empty.count() == 0
    again = assign_ids(assign_ids(spark.range(3), ["id"]), [F.col("id").desc()])
    assert sorted(map(tuple, again.collect())) == [(0, 2), (1, 1), (2, 0)]
    assert {r["batch"] for r in batch_numbers(again, 2).collect()} == {0, 1}


def test_source_order(spark):
    df = spark.createDataFrame([("ACM",), ("PubMed",), ("IEEE",), ("X",)], "source STRING")
    assert [r[0] for r in df.orderBy(source_rank()).collect()] == ["IEEE", "PubMed", "ACM", "X"]


def test_keys_tell_values_apart(spark):
    rows = [(None, None), ("", None), (None, ""), ("-", ""), ("a", "bc"), ("ab", "c"), ("x" * 70, "y"), ("x" * 69, "xy"), ("=", "1=")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    keys = df.select(key_of("a", "b").alias("k"), key_of("a").alias("one")).collect()
    assert len({r["k"] for r in keys}) == len(rows)
    assert len({r["one"] for r in keys}) == len({a for a, _ in rows})
    assert max(len(r["k"]) for r in keys) <= 65


def _source(spark, name, years):
    rows = [(name, f"{name}{i}", y, "f", 0, i, f"10.1/{i % 4}") for i, y in enumerate(years)]
    return spark.createDataFrame(
        rows, "source STRING, title STRING, year INT, ingest_file STRING, record_kind INT, ingest_seq BIGINT, doi STRING")


def test_run_caps_before_it_filters(spark):
    """The cap counts articles that the year filter then takes out; IEEE has no cap."""
    sources = [
        _source(spark, "ACM", [2001, 1990, 2002]), _source(spark, "IEEE", [2000] * 4), _source(spark, "PubMed", [1990, None, 2003]),
    ]
    run = build_run(sources, Params(start_year=2000, max_results=2), "r1")
    rows = run.orderBy("article_id").collect()
    assert [r["article_id"] for r in rows] == list(range(6))
    assert [r["title"] for r in rows] == ["IEEE0", "IEEE1", "IEEE2", "IEEE3", "PubMed1", "ACM0"]
    assert run.columns == ["article_id", "run_id", *ARTICLE_COLUMNS]
    marked = screen_runs(run, Params(screening="Pilot", nr_randomizations=3))
    assert marked.where("pilot = 'x'").count() == 3
    assert {r["title"]: r["duplicate"] for r in marked.collect()} == {
        "IEEE0": "x", "IEEE1": "x", "IEEE2": "", "IEEE3": "", "PubMed1": "x", "ACM0": "x"}
    assert "pilot" not in screen_runs(run, Params()).columns


def test_params_from_ini(tmp_path):
    ini = tmp_path / "p.ini"
    ini.write_text("[search]\nstart_year = 2014\nend_year = None\nmax_results = None\n[pilot]\nscreening = Pilot\nnr_randomizations = 30\n")
    assert Params.from_ini(str(ini)) == Params(2014, None, None, "Pilot", 30)
    ini.write_text("[search]\nstart_year = None\n[pilot]\nscreening = None\n")
    assert Params.from_ini(str(ini)) == Params()
