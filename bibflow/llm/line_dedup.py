r"""Boilerplate lines by their frequency within a site, on built-in functions only.

Lines that many pages of one host share are navigation, banners and licence
notes. For each host, the pages that hold a line are divided by the pages of
the host, and lines beyond a ratio are dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.plans.skew import KEY, ROWS, sliced_join
from bibflow.runtime import materialise

#: Tags that begin or end a line of text. Fixed values.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: Entities that are decoded, in this order. Fixed values.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&"))

def host_of(url: Column) -> Column:
    """The host of an address in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def page_text(html: Column) -> Column:
    """The visible text of a page, one line per block element."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>", "")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.trim(text, F.lit(" \n\t\r")), r"[ \t\r]*\n[ \t\r\n]*", "\n")


def _key(line: Column) -> Column:
    """16 bytes for a line without its margins; null for a blank one."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = 0.5, min_pages: int = 4,
                copies_once: bool = False) -> DataFrame:
    """Per site, ``keys`` of the lines on more than ``ratio`` of its pages and on ``min_pages`` or more.

    With ``copies_once``, the pages of a site with one text are one page, in the
    counts of its lines and of its pages.

    A site's list is short whatever its size: at most the lines of its average
    page divided by ``ratio``. Counts are summed within tasks before they are shuffled.
    """
    lines = F.array_distinct(F.array_compact(F.transform(F.split(F.col(text), "\n"), _key)))
    usable = pages.where(F.col(site).isNotNull())
    if copies_once:
        # Of a text only the keys of its lines are shuffled, and once per task.
        usable = usable.groupBy(F.col(site).alias("_llm_site"), F.unhex(F.md5(text)).alias("_llm_copy")).agg(
            F.first(lines).alias("_llm_lines"))
    else:
        usable = usable.select(F.col(site).alias("_llm_site"), lines.alias("_llm_lines"))
    totals = usable.groupBy("_llm_site").agg(F.count("*").alias("_llm_total"))
    # Of an inner explode Spark makes a filter on the array's size, which works out all texts again.
    frequent = (
        usable.select("_llm_site", F.explode_outer("_llm_lines").alias("_llm_line")).where("_llm_line IS NOT NULL")
        .groupBy("_llm_site", "_llm_line").agg(F.count("*").alias("_llm_pages"))
        .where(F.col("_llm_pages") >= min_pages)
    )
    often = frequent.join(totals, "_llm_site").where(F.col("_llm_pages") > F.col("_llm_total") * F.lit(ratio))
    return often.groupBy("_llm_site").agg(F.collect_list("_llm_line").alias("_llm_keys"))


def drop_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = 0.5, min_pages: int = 4,
                     copies_once: bool = False) -> DataFrame:
    """All rows with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` added.

    A line counts once per page; lines are compared without the white space at
    their ends. Blank lines are never counted or dropped and do not count as
    ``n_lines``. Rows without a site lose nothing; a null text stays null with
    zero lines. Repeated rows are pages of their own, unless ``copies_once``: then
    equal texts of a site count as one page, so that copies do not make their own
    lines boilerplate. A page of which nothing is
    left keeps its row with an empty text. Added columns replace ones of their name.

    The list of each site comes to its pages by a join. Sites with very many pages
    are cut into slices by their counts, and their list is copied per slice.
    Names that begin with ``_llm_`` or an underscore and ``key`` are this operator's own: such columns are dropped.
    """
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped", KEY) and not c.startswith("_llm_")]
    pages = pages.select(*kept)
    lists = materialise(boilerplate(pages, site, text, ratio, min_pages, copies_once), "lines")
    counts = pages.where(F.col(site).isNotNull()).groupBy(F.col(site).alias(KEY)).agg(F.count("*").alias(ROWS))
    joined = sliced_join(
        pages.withColumn(KEY, F.col(site)), lists.withColumnRenamed("_llm_site", KEY), "left", counts)
    lines = F.split(F.col(text), "\n")
    left = F.when(F.col("_llm_keys").isNull(), lines).otherwise(
        F.filter(lines, lambda line: ~F.coalesce(F.array_contains("_llm_keys", _key(line)), F.lit(False))))
    filled = F.coalesce(F.size(F.filter(lines, lambda line: F.trim(line, F.lit(" \t\r")) != "")), F.lit(0))
    joined = joined.withColumns({"_llm_left": left, "_llm_dropped": F.size(lines) - F.size(left), "_llm_filled": filled})
    cleaned = F.when(F.col("_llm_dropped") > 0, F.array_join("_llm_left", "\n")).otherwise(F.col(text)).alias(text)
    present = F.col(text).isNotNull()
    return joined.select(
        *[cleaned if c == text else F.col(c) for c in kept],
        F.when(present, F.col("_llm_filled")).otherwise(0).cast("bigint").alias("n_lines"),
        F.when(present, F.col("_llm_dropped")).otherwise(0).cast("bigint").alias("n_dropped"),
    )
