"""ACM result pages, given as a table of pages: ``page_id``, ``url``, ``html``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.functions import listing as fields
from bibflow.operators.compare import attach_detail
from bibflow.plans.skew import Limits
from bibflow.runtime import materialise
from bibflow.schema import ARTICLE_COLUMNS


def read_items(pages: DataFrame) -> DataFrame:
    """The result items of every page, in page order, without abstracts."""
    items = pages.select("page_id", F.posexplode(fields.items(F.col("html"))).alias("pos", "item"))
    item, when = F.col("item"), F.col("date_text")
    return (
        items.withColumn("date_text", fields.date_text(item))
        .select(
            "page_id",
            "pos",
            F.lit("ACM").alias("source"),
            fields.title(item).alias("title"),
            fields.authors(item).alias("authors"),
            fields.date(when).alias("date"),
            fields.year(when).alias("year"),
            fields.journal(item).alias("journal_book"),
            fields.doi(item).alias("doi"),
            fields.url(item).alias("url"),
            fields.citation(item).alias("citation"),
        )
    )


def read_listing(pages: DataFrame, details: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """ACM articles: the items of the result pages with the abstracts of their detail pages.

    Items are written before their keys are counted, so pages are parsed once.
    """
    abstracts = details.select("page_id", "url", fields.detail_abstract(F.col("html")).alias("abstract"))
    items = attach_detail(materialise(read_items(pages), "items"), abstracts, on="url", order="page_id", limits=limits)
    none = F.lit(None).cast("string")
    articles = items.withColumns({"pmid": none, "keywords": none})
    return articles.select(
        F.format_string("%020d", "page_id").alias("ingest_file"),
        F.lit(0).alias("record_kind"),
        F.col("pos").cast("bigint").alias("ingest_seq"),
        *ARTICLE_COLUMNS,
    )


def reported_hits(pages: DataFrame) -> DataFrame:
    """Per page, the number of results that the library reports."""
    return pages.select("page_id", fields.hits(F.col("html")).alias("hits"))
