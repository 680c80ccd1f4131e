"""Whole answers put together from pages that came in any order, more than once, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids of each search by their place in the whole answer, and a report per search on how well they cover it.

    ``pages`` has a row per id: ``search``, ``total``, ``start`` and ``size`` of its page, ``position`` in the page and ``pmid``,
    as ``read_search_pages`` gives them; a page without ids has one row without a position.

    Ids: ``search``, ``place`` from 0, ``pmid``; once each, however often their page came. Where pages
    disagree on a place the smallest id stands, and the report counts the place. Report: ``total`` (the largest
    reported), ``totals_agree``, ``found`` places, ``missing`` ones below the total, ``gaps`` (runs of missing places), ``repeated``
    places (on more than one page) and ``conflicts``. Places are counted by search and place, so a search with very many
    ids is spread over tasks; gaps are found on pages, in the order of their starts.
    """
    ids = pages.where("position IS NOT NULL").select("search", (F.col("start") + F.col("position")).alias("place"), "pmid")
    places = ids.groupBy("search", "place").agg(
        F.min("pmid").alias("pmid"), F.max("pmid").alias("other"), F.count("*").alias("times"))
    counted = places.groupBy("search").agg(
        F.count("*").alias("found"),
        F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("pmid") != F.col("other")).alias("conflicts"))
    # Pages of one start are one stretch, as long as the longest.
    stretches = pages.groupBy("search", "start").agg(
        F.max(F.col("start") + F.col("size")).alias("end"), F.min("total").alias("least"), F.max("total").alias("most"))
    before = Window.partitionBy("search").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    opened = stretches.where("start IS NOT NULL").withColumn("gap", F.greatest(F.col("start") - reached, F.lit(0)))
    covered = opened.groupBy("search").agg(
        F.min("least").alias("least"), F.max("most").alias("total"), F.max("end").alias("end"),
        F.sum("gap").alias("inside"), F.count_if(F.col("gap") > 0).alias("gaps_inside"))
    rest = F.greatest(F.col("total") - F.col("end"), F.lit(0))
    report = covered.join(counted, "search", "left").select(
        "search", "total", (F.col("least") == F.col("total")).alias("totals_agree"), F.coalesce("found", F.lit(0)).alias("found"),
        (F.col("inside") + rest).alias("missing"), (F.col("gaps_inside") + (rest > 0).cast("bigint")).alias("gaps"),
        F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    return places.select("search", "place", "pmid"), report
