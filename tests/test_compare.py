from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bibflow.operators.compare import attach_detail, compare_runs, restrict_to_ids, select_run
from bibflow.plans.skew import Limits
from bibflow.sinks import number_comparison

SHUFFLED = Limits(broadcast_keys=0, hot_rows=2)
OLD = "article_id BIGINT, title STRING, notes STRING, kept STRING"
NEW = "article_id BIGINT, title STRING, extra STRING"


def brute_force(old, new):
    old_titles, new_titles = {t for _, t, *_ in old}, {t for _, t, *_ in new}
    rows = [(0, i, t, notes if t in new_titles else "Remove", k, None) for i, t, notes, k in old]
    return Counter(rows + [(1, i, t, "Add", None, e) for i, t, e in new if t not in old_titles])


def compared(spark, old, new, limits=Limits()):
    result = compare_runs(
        spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW), with_side=True, limits=limits
    )
    assert result.columns == ["article_id", "title", "notes", "kept", "extra", "side"]
    return Counter((r["side"], r["article_id"], r["title"], r["notes"], r["kept"], r["extra"]) for r in result.collect())


titles = st.sampled_from([None, "", "a", "b", "c", "A", "long " * 40])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(titles, max_size=15), st.lists(titles, max_size=15))
def test_compare_equals_set_difference(spark, old_titles, new_titles):
    old = [(i, t, "note" if i % 2 else None, "k") for i, t in enumerate(old_titles)]
    new = [(i, t, "e") for i, t in enumerate(new_titles)]
    want = brute_force(old, new)
    assert compared(spark, old, new) == compared(spark, old, new, SHUFFLED) == want


def test_missing_titles_match_each_other(spark):
    old = [(0, None, "seen", "k"), (1, "a", "seen", "k")]
    assert compared(spark, old, [(0, None, "e")]) == {
        (0, 0, None, "seen", "k", None): 1, (0, 1, "a", "Remove", "k", None): 1}


def test_hot_titles(spark):
    """A third of each run under one title and a third without a title, joined by shuffle."""
    title = lambda i, side: [None, "hot", f"{side if i % 2 else ''}{i}"][i % 3]
    old = [(i, title(i, "o"), None, "k") for i in range(600)]
    new = [(i, title(i, "n"), "e") for i in range(600)]
    limits = Limits(broadcast_keys=0, hot_rows=20)
    assert compared(spark, old, new, limits) == brute_force(old, new)


def test_run_against_itself_and_empty_runs(spark):
    old = [(i, t, None, "k") for i, t in enumerate(["a", "a", None])]
    new = [(i, t, "e") for i, t, *_ in old]
    assert {notes for _, _, _, notes, *_ in compared(spark, old, new)} == {None}
    assert {notes for _, _, _, notes, *_ in compared(spark, old, [])} == {"Remove"}
    assert {notes for _, _, _, notes, *_ in compared(spark, [], new)} == {"Add"}


def test_old_run_without_notes(spark):
    old = spark.createDataFrame([(0, "a")], "article_id BIGINT, title STRING")
    new = spark.createDataFrame([(0, "b")], "article_id BIGINT, title STRING")
    assert sorted(map(tuple, compare_runs(old, new).collect())) == [(0, "a", "Remove"), (0, "b", "Add")]


def test_new_numbers_keep_old_rows_first(spark):
    old = spark.createDataFrame([(5, "a"), (7, "b")], "article_id BIGINT, title STRING")
    new = spark.createDataFrame([(0, "c"), (1, "a")], "article_id BIGINT, title STRING")
    rows = number_comparison(compare_runs(old, new, with_side=True)).orderBy("article_id").collect()
    assert [tuple(r) for r in rows] == [(0, 5, "a", None), (1, 7, "b", "Remove"), (2, 0, "c", "Add")]


def test_select_run(spark):
    runs = spark.createDataFrame([("2023-01-01_a", 1), ("2024-01-01_b", 2), ("2022-01-01_b", 3)], "run_id STRING, n INT")
    assert select_run(runs).first()["n"] == 2
    assert select_run(runs, contains="_a").first()["n"] == 1
    assert select_run(runs, "2022-01-01_b").first()["n"] == 3
    with pytest.raises(ValueError):
        select_run(runs, contains="xlsx")


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED])
def test_restrict_to_ids(spark, limits):
    records = spark.createDataFrame([("1", 0), ("1", 1), ("2", 2), (None, 3)], "pmid STRING, n INT")
    ids = spark.createDataFrame([("1",), ("1",), (None,), ("9",)], "pmid STRING")
    assert sorted(r["n"] for r in restrict_to_ids(records, ids, limits=limits).collect()) == [0, 1]


def test_detail_of_a_hot_url(spark):
    items = spark.createDataFrame(
        [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"u{i}") for i in range(300)], "n INT, url STRING")
    details = spark.createDataFrame(
        [(2, "hot", "late"), (1, "hot", "first"), (3, "u2", "two"), (4, None, "no")], "page_id INT, url STRING, abstract STRING")
    rows = attach_detail(items, details, order="page_id", limits=Limits(hot_rows=10)).collect()
    got = {r["n"]: r["abstract"] for r in rows}
    assert len(rows) == len(got) == 300
    assert all(got[n] == ("first" if n % 3 == 1 else "two" if n == 2 else None) for n in got)
