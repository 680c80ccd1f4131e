"""Answers put together from pages."""

import random

from bibflow.operators.pages import assemble_pages
from bibflow.sources.pubmed import read_search_pages

COLUMNS = "search string, total bigint, start bigint, size bigint, position int, pmid string"


def rows(search, total, start, ids):
    return [(search, total, start, len(ids), k, i) for k, i in enumerate(ids)] or [(search, total, start, 0, None, None)]


def test_gaps_repeats_overlaps_and_conflicts(spark):
    pages = [
        *rows("a", 9, 0, ["1", "2", "3"]), *rows("a", 9, 3, ["4", "5", "6"]), *rows("a", 9, 6, ["7", "8", "9"]),
        *rows("b", 10, 2, ["3", "4"]), *rows("b", 10, 3, ["4", "5"]), *rows("b", 10, 2, ["3", "4"]), *rows("b", 11, 7, ["x"]),
        *rows("c", 2, 0, ["1", "2"]), *rows("c", 2, 0, ["2"]), *rows("d", 0, 0, []), *rows("e", 4, 0, []),
    ]
    random.Random(1).shuffle(pages)
    ids, report = assemble_pages(spark.createDataFrame(pages, COLUMNS))
    assert sorted((r.search, r.place, r.pmid) for r in ids.collect()) == [
        *[("a", k, str(k + 1)) for k in range(9)], ("b", 2, "3"), ("b", 3, "4"), ("b", 4, "5"), ("b", 7, "x"), ("c", 0, "1"), ("c", 1, "2")]
    names = ("total", "totals_agree", "found", "missing", "gaps", "repeated", "conflicts")
    assert {r.search: tuple(r[n] for n in names) for r in report.collect()} == {
        "a": (9, True, 9, 0, 0, 0, 0), "b": (11, False, 4, 7, 3, 2, 0), "c": (2, True, 2, 0, 0, 1, 1),
        "d": (0, True, 0, 0, 0, 0, 0), "e": (4, True, 0, 4, 1, 0, 0)}


def test_no_pages(spark):
    ids, report = assemble_pages(spark.createDataFrame([], COLUMNS))
    assert ids.collect() == report.collect() == []


def test_pages_as_landed(spark, tmp_path):
    page = ("<?xml version='1.0'?><eSearchResult><Count>1,200</Count><RetMax>2</RetMax><RetStart>{}</RetStart><QueryKey>1</QueryKey>"
            "<WebEnv>E</WebEnv><IdList>{}</IdList></eSearchResult>")
    (tmp_path / "2.xml").write_text(page.format(2, "<Id>30</Id><Id>40</Id>"))
    (tmp_path / "1.xml").write_text(page.format(0, "<Id>10</Id><Id>20</Id>"))
    (tmp_path / "3.xml").write_text(page.format(4, ""))
    ids, report = assemble_pages(read_search_pages(spark, str(tmp_path)))
    assert sorted((r.place, r.pmid) for r in ids.collect()) == [(0, "10"), (1, "20"), (2, "30"), (3, "40")]
    assert [tuple(r) for r in report.collect()] == [("E/1", 1200, True, 4, 1196, 1, 0, 0)]
