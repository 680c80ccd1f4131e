"""Plans have the shape that holds at scale."""

import re

import __spark_entry__ as registered
from bibflow.operators import compare, harmonise, screen, search
from bibflow.plans.skew import Limits, sliced_join


def plan(df) -> str:
    df.collect()  # the adaptive plan is final only after a run
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "articles")
    spark.createDataFrame([(1, 2000, "t"), (2, None, "t")], "article_id BIGINT, year INT, title STRING").write.parquet(path)
    df = harmonise.year_between(spark.read.parquet(path), 1999, 2001).select("article_id")
    text = plan(df)
    assert re.search(r"PushedFilters: \[.*IsNull\(year\).*GreaterThanOrEqual\(year,1999\)", text)
    assert "ReadSchema: struct<article_id:bigint,year:int>" in text


def test_duplicates_shuffle_keys_only(spark, sf_dir):
    docs = registered.documents(spark, sf_dir).withColumnRenamed("text", "doi")
    text = plan(screen.mark_duplicates(docs, run_key="source"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_long_key_lists_are_shuffled_not_broadcast(spark, sf_dir):
    docs = registered.documents(spark, sf_dir).withColumnRenamed("text", "doi")
    limits = Limits(broadcast_keys=0, hot_rows=2)
    with_stats = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(screen.mark_duplicates(docs, run_key=None, limits=limits))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_stats)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert re.search(r"hashpartitioning\(_key#\d+, _slice#\d+", text)


def test_details_move_once_where_no_key_is_hot(spark):
    items = spark.range(40).selectExpr("id", "IF(id % 4 = 0, NULL, CAST(id AS STRING)) AS url")
    details = spark.range(80).selectExpr("id AS place", "IF(id > 70, NULL, CAST(id % 35 AS STRING)) AS url", "CAST(id AS STRING) AS text")
    df = compare.attach_detail(items, details, order="place")
    rows = {r["id"]: r["text"] for r in df.collect()}
    assert rows == {i: None if i % 4 == 0 or i >= 35 else str(i) for i in range(40)}
    assert plan(df).split("== Initial Plan ==")[0].count("hashpartitioning") == 2


def test_rows_without_a_key_match_no_key(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "_key STRING, v INT").repartition(1)
    right = spark.createDataFrame([("-0", 1), ("a", 2), ("-", 3)], "_key STRING, w INT")
    assert sorted(sliced_join(left, right, "left").collect(), key=lambda r: r["v"]) == [(None, 1, None), ("a", 2, 2), (None, 3, None)]
    assert sliced_join(left, right, "left_semi").collect() == [("a", 2)]


def test_caps_and_searches_do_not_move_wide_rows(spark, sf_dir):
    docs = registered.documents(spark, sf_dir)
    capped = plan(harmonise.cap_per_source(docs, 3, ["source"], ["doc_id"]))
    assert "hashpartitioning" not in capped and "rangepartitioning" not in capped
    articles = docs.selectExpr("doc_id AS article_id", "text AS abstract")
    strategy = registered._strategy_tables(spark, ["articles and joins"])
    assert "Exchange" not in plan(search.boolean_search(articles, *strategy))


def test_ids_have_no_single_task_sort(spark, sf_dir):
    docs = registered.documents(spark, sf_dir)
    assert "SinglePartition" not in plan(harmonise.assign_ids(docs, ["doc_id"]))


def test_comparison_moves_keys_not_rows(spark, sf_dir):
    text = plan(compare.compare_runs(*registered._runs(spark, sf_dir)))
    assert "hashpartitioning(title" not in text
