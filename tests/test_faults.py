"""Faulty files, runs by stream and batch, many hot keys, and long strategies."""

import pytest
from pyspark.sql import functions as F

from bibflow import sinks
from bibflow.functions.text import decode_entities, in_natural_order, thousands_to_int, year_number
from bibflow.operators import search
from bibflow.operators.harmonise import conform
from bibflow.plans.skew import KEY, ROWS, Limits, hot_keys
from bibflow.schema import SEARCH_TYPES, TERMS
from bibflow.sources import delimited, pubmed


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, decode_entities(F.lit("&#00000038;&#x0000026;&#38;&#9999999999;"))) == "&&&&#9999999999;"
    assert one(spark, thousands_to_int(F.lit("3,000,000,000"))) == 3_000_000_000
    assert [one(spark, year_number(F.lit(y))) for y in ("2014", " 2014.0 ", "2014.5", "x", None)] == [2014, 2014, None, None, None]
    paths = ["b_10.csv", "b_2.csv", "b_1/10", "b_1/9", "b_007"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(in_natural_order(F.col("p")))
    assert [r.p for r in df.collect()] == ["b_1/9", "b_1/10", "b_2.csv", "b_007", "b_10.csv"]


def test_years_with_a_decimal_part(spark):
    df = spark.createDataFrame([("2014.0",), ("2015",), ("n/a",)], "year string")
    assert [r.year for r in conform(df).collect()] == [2014, 2015, None]


@pytest.mark.parametrize("body,fault", [
    ("1;2\n3;4;5\n", True), ("1;2\n3\n", False), ('1;"2;3"\n4;5\n', False), ('1;2\n"3;4\n5;6\n', True), ("1;2\n", False)])
def test_malformed_csv_stops_the_job(spark, tmp_path, body, fault):
    path = tmp_path / "t.csv"
    path.write_text("a;b\n" + body)
    df = delimited.read_delimited(spark, str(path), ";")
    if fault:
        with pytest.raises(Exception, match="malformed record"):
            df.collect()
        with pytest.raises(Exception, match="malformed record"):
            df.count()
    else:
        assert df.count() == body.count("\n")
    good, bad = delimited.split_malformed(spark, str(path), ";")
    assert (bad.count() > 0) == fault and good.where("a = '1'").count() == 1


RECORD = "<PubmedArticle><MedlineCitation><PMID>{}</PMID></MedlineCitation></PubmedArticle>"


def test_one_malformed_record_is_set_apart(spark, tmp_path):
    """The others of its file are read; without setting faults apart the job stops."""
    (tmp_path / "good.xml").write_text(f"<PubmedArticleSet>{RECORD.format(1)}{RECORD.format(2)}</PubmedArticleSet>")
    assert pubmed.read_pubmed(spark, str(tmp_path)).count() == 2
    bad = f"<PubmedArticleSet>{RECORD.format(3)}<PubmedArticle><MedlineCitation><PMID>4</MedlineCitation></PubmedArticle>{RECORD.format(5)}"
    cut = "<PubmedBookArticle><BookDocument><PMID>6</PMID>"
    (tmp_path / "bad.xml").write_text(f"{bad}{cut}</PubmedArticleSet>")
    with pytest.raises(Exception, match="malformed record"):
        pubmed.read_pubmed(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="malformed record"):
        pubmed.read_pubmed(spark, str(tmp_path)).count()
    (tmp_path / "error.xml").write_text(f"<E>{pubmed.ERROR_TEXT}\nDetails:  no backend</E>")
    (tmp_path / "none.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    (tmp_path / "empty.xml").write_text("")
    records, rejected = pubmed.split_malformed(spark, str(tmp_path))
    assert sorted(r.pmid for r in records.collect()) == ["1", "2", "3", "5"] and records.count() == 4
    assert sorted((r.file.rsplit("/", 1)[1], r.place, r.details) for r in rejected.collect()) == [
        ("bad.xml", 2, pubmed.MALFORMED), ("bad.xml", 4, pubmed.MALFORMED), ("error.xml", 0, "no backend")]


def test_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{RECORD.format(1)}</PubmedArticleSet>")
    plan = pubmed.read_pubmed(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.lower().count("from_xml") + plan.lower().count("xmltostructs") == 2


def test_a_streamed_run_is_not_replaced_by_halves(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("007", "a")], "run_id string, title string")
    sinks.write_batch(df, path, 0)
    sinks.write_batch(df, path, 1)
    sinks.write_batch(df, path, 1)
    assert sinks.read_runs(spark, path).count() == 2
    with pytest.raises(ValueError, match="run 007 was written by a stream"):
        sinks.write_run(df, path)
    sinks.write_run(df.withColumn("run_id", F.lit("7")), path)
    assert sorted(r.run_id for r in sinks.read_runs(spark, path).collect()) == ["007", "007", "7"]


def test_a_run_written_at_once_is_not_added_to_by_a_stream(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("r1", "a")], "run_id string, title string")
    sinks.write_run(df, path)
    with pytest.raises(ValueError, match="run r1 was written at once"):
        sinks.write_batch(df, path, 0)
    assert sinks.read_runs(spark, path).count() == 1 and len(list((tmp_path / "runs").glob("run_id=*/part=*"))) == 1


def test_columns_of_all_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_run(spark.createDataFrame([("r1", "a", "x")], "run_id string, title string, kind string"), path)
    sinks.write_run(spark.createDataFrame([("r2", "b", 7), (None, "c", 8)], "run_id string, title string, extra int"), path)
    rows = sinks.read_runs(spark, path)
    assert sorted(rows.columns) == ["extra", "kind", "run_id", "title"]
    rows = rows.select("title", "kind", "extra", "run_id")
    assert sorted(map(tuple, rows.collect()), key=repr) == [("a", "x", None, "r1"), ("b", None, 7, "r2"), ("c", None, 8, None)]
    sinks.write_run(spark.createDataFrame([(None, "d")], "run_id string, title string"), path)
    assert sorted(r.title for r in sinks.read_runs(spark, path).collect()) == ["a", "b", "d"]
    sinks.write_run(spark.createDataFrame([("r3", 1.5)], "run_id string, extra double"), path)
    with pytest.raises(ValueError, match="extra was written as"):
        sinks.read_runs(spark, path)


def test_a_writer_that_stops_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    """Before its snapshot is written, nothing that a writer wrote is read, and nothing is taken away."""
    path = str(tmp_path / "runs")
    odd = "2024:01/02 %"
    sinks.write_run(spark.createDataFrame([(odd, "old")], "run_id string, title string"), path)
    later = spark.createDataFrame([(odd, "new")], "run_id string, title string")
    with monkeypatch.context() as stopped:
        def stop(*_):
            raise KeyboardInterrupt
        stopped.setattr(sinks.T.StructType, "json", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_run(later, path)
    assert [tuple(r) for r in sinks.read_runs(spark, path).collect()] == [("old", odd)]
    # A snapshot that was not finished does not count either.
    (tmp_path / "runs" / "_manifest" / "snapshots" / "v000000000099").mkdir()
    sinks.write_run(later, path)
    assert [tuple(r) for r in sinks.read_runs(spark, path).collect()] == [("new", odd)]


def test_a_table_without_a_manifest(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, column in (("007", "a"), ("008", "b")):
        spark.createDataFrame([(run, "all", 1)], f"run_id string, part string, {column} int").write.mode("append").partitionBy(
            "run_id", "part").parquet(path)
    assert sorted((r.run_id, r.a, r.b) for r in sinks.read_runs(spark, path).collect()) == [("007", 1, None), ("008", None, 1)]


def test_a_landed_file_is_taken_once(spark, tmp_path):
    """Whatever the batch; another run may take it too."""
    path = str(tmp_path / "runs")
    columns = "run_id string, title string, ingest_path string"
    rows = [("r1", f"t{k}", f"file:/landed/{k // 2}.xml") for k in range(6)]
    sinks.write_batch(spark.createDataFrame(rows[:4], columns), path, 0)
    sinks.write_batch(spark.createDataFrame(rows, columns), path, 0)
    sinks.write_batch(spark.createDataFrame(rows[:2], columns), path, 1)
    sinks.write_batch(spark.createDataFrame([("r2", *r[1:]) for r in rows[:2]], columns), path, 0)
    found = sinks.read_runs(spark, path)
    assert sorted((r.run_id, r.title) for r in found.collect()) == [("r1", f"t{k}") for k in range(6)] + [("r2", "t0"), ("r2", "t1")]
    assert found.columns == ["title", "run_id"]


def test_rejected_answers_are_written_once(spark, tmp_path):
    path = str(tmp_path / "rejected")
    failed = spark.createDataFrame([("f", "d")], "file string, details string")
    for _ in range(2):
        sinks.write_rejected(failed, path, "r1")
    assert sinks.read_runs(spark, path).count() == 1


def test_every_hot_key_is_listed_and_the_list_is_bounded(spark):
    counts = spark.range(1, 30_001).select(F.col("id").cast("string").alias(KEY), F.lit(10).cast("bigint").alias(ROWS))
    hot = hot_keys(counts, Limits(hot_rows=2, broadcast_keys=250_000))
    assert hot.count() == 30_000 and hot.agg(F.min("_slices")).first()[0] == 5
    few = hot_keys(counts, Limits(hot_rows=2, broadcast_keys=1_000))
    assert few.count() == 0  # a slice may have 300 rows, and no key has more


def strategy(spark, words, kind="Title/Abstract"):
    terms = spark.createDataFrame([("s", "c", 0, False, i, w) for i, w in enumerate(words)], TERMS)
    return terms, spark.createDataFrame([("s", "c", kind)], SEARCH_TYPES)


def test_long_strategies_give_the_same_articles(spark, monkeypatch):
    articles = spark.createDataFrame([(k, f"word{k} end", k) for k in range(50)] * 2, "article_id int, title string, n int")
    terms = strategy(spark, [f"word{k}" for k in range(0, 50, 3)] + ["en*"][:0])
    short = sorted(map(tuple, search.boolean_search(articles, *terms).collect()))
    monkeypatch.setattr(search, "_ONE_STRATEGY", 3)
    assert sorted(map(tuple, search.boolean_search(articles, *terms).collect())) == short and len(short) == 34


def test_missing_columns_and_types_raise(spark):
    articles = spark.createDataFrame([(1, "x")], "article_id int, keywords string")
    for operator in (search.boolean_search, search.match_searches):
        with pytest.raises(ValueError, match="none of the columns"):
            operator(articles, *strategy(spark, ["x"]))
        terms, types = strategy(spark, ["x"])
        with pytest.raises(ValueError, match="category without a search type"):
            operator(articles, terms, types.where("false"))
