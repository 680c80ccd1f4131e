import pytest

from bibflow.operators.render import render_queries
from bibflow.schema import EXCLUSION_CATEGORY, SEARCH_TYPES, SYNTAX, TERMS

SYNTAXES = [
    ("PubMed", "Title", 0, "After", "[Title]"),
    ("IEEE", "Title", 0, "Before", '"T": '), ("IEEE", "Title", 1, "Before", '"A": '),
    ("ACM", "Title", 0, "Before", "T:( "), ("ACM", "Title", 1, "Before", "A:("), ("ACM", "Title", 2, "After", ") "),
    ("Two", "Title", 0, "Before", "<"), ("Two", "Title", 1, "After", ">"), ("Two", "Title", 2, "After", "]"),
    ("Ends", "Title", 0, "After", "[a]"), ("Ends", "Title", 1, "After", "[b]"),
]


def rendered(spark, categories, databases=None, types=None, syntax=SYNTAXES):
    terms = [
        ("s", name, pos, name == EXCLUSION_CATEGORY, i, term)
        for pos, (name, words) in enumerate(categories) for i, term in enumerate(words)
    ]
    types = [("s", name, "TITLE") for name, _ in categories] if types is None else types
    rows = render_queries(
        spark.createDataFrame(terms, TERMS), spark.createDataFrame(syntax, SYNTAX),
        spark.createDataFrame(types, SEARCH_TYPES), databases,
    ).collect()
    return {r["database"]: r["query"] for r in rows}


def test_every_kind_of_syntax(spark):
    got = rendered(spark, [("C1", ["b", '"a x"']), ("c2", ["z*"]), (EXCLUSION_CATEGORY, ["r"])])
    assert got == {
        "PubMed": '(b[Title] OR "a x"[Title]) AND (z*[Title]) NOT (r[Title])',
        "IEEE": '("T": b OR "T": "a x" OR "A": b OR "A": "a x") AND ("T": z* OR "A": z*) NOT ("T": r OR "A": r)',
        "ACM": '(T:( b)  OR T:( "a x")  OR A:(b)  OR A:("a x") ) AND (T:( z*)  OR A:(z*) ) NOT (T:( r)  OR A:(r) )',
        "Two": "() AND () NOT ()",
        "Ends": '(b[a] OR "a x"[a] OR b[b] OR "a x"[b]) AND (z*[a] OR z*[b]) NOT (r[a] OR r[b])',
    }


def test_exclusion_first(spark):
    got = rendered(spark, [(EXCLUSION_CATEGORY, ["r"]), ("c", ["a"])], ["pubmed"])
    assert got == {"PubMed": " NOT (r[Title]) AND (a[Title])"}


def test_more_than_ten_terms_keep_their_order(spark):
    got = rendered(spark, [("c", [f"t{i}" for i in range(12)])], ["PUBMED"])
    assert got["PubMed"] == "(" + " OR ".join(f"t{i}[Title]" for i in range(12)) + ")"


def test_category_without_a_search_type_raises(spark):
    with pytest.raises(ValueError, match="category without a search type: s, c1"):
        rendered(spark, [("c1", ["a"]), ("c2", ["b"])], ["IEEE"], types=[("s", "C2", "title")])


def test_syntax_of_each_search(spark):
    terms = spark.createDataFrame([(s, "c", 0, False, 0, "a") for s in ("s", "t")], TERMS)
    types = spark.createDataFrame([(s, "C", "title") for s in ("s", "t")], SEARCH_TYPES)
    syntax = spark.createDataFrame(
        [("s", "X", "Title", 0, "After", "[1]"), ("t", "X", "Title", 0, "After", "[2]")], f"search_id STRING, {SYNTAX}")
    rows = render_queries(terms, syntax, types).collect()
    assert sorted(map(tuple, rows)) == [("s", "X", "(a[1])"), ("t", "X", "(a[2])")]


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="database not found"):
        rendered(spark, [("c", ["a"])], ["Scopus"])
    with pytest.raises(ValueError, match="search type not found"):
        rendered(spark, [("c", ["a"])], types=[("s", "c", "Body")])
