"""Fields of an ACM result list and of its detail pages, taken from HTML.

A one-word class matches any of an element's classes; a class with blanks
must be the whole attribute. A capture ends at the element's own closing tag,
whatever elements of the same name are nested in it. Where tags of that name do
not balance, it ends at the first closing tag.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibflow.functions.text import comma_list, extract, let, markup_text, thousands_to_int, trimmed

# Addresses, element classes and formats of the result pages.
SITE = "https://dl.acm.org"
ITEM_CLASS = "search__item issue-item-container"
TITLE_CLASS = "hlFld-Title"
AUTHORS_CLASS = "rlist--inline loa truncate-list"
DATE_CLASS = "bookPubDate simple-tooltip__block--b"
JOURNAL_CLASS = "epub-section__title"
DOI_CLASS = "issue-item__doi dot-separator"
CITATION_CLASS = "citation"
HITS_CLASS = "hitsLength"
DOI_PATTERN = r"10\.\d{4,9}/[^\s]+"
YEAR_PATTERN = r"\b\d{4}\b"


def opening(tag: str, **attributes: str) -> str:
    """Pattern of an opening tag that carries the given attributes."""
    ahead = ""
    for name, value in attributes.items():
        exact = name != "class_" or " " in value
        value = re.escape(value)
        inner = value if exact else rf"(?:[^\"'>]*\s)?{value}(?:\s[^\"'>]*)?"
        ahead += rf"(?=[^>]*\s{name.rstrip('_')}\s*=\s*[\"']{inner}[\"'])"
    return rf"<{tag}\b{ahead}[^>]*>"


def outermost(html: Column, tag: str) -> Column:
    """Inner HTML of every element of this name that is in no other one of it.

    A fold over the tags of that name counts how deep they are nested. Elements
    that are never closed are left out, and so are closing tags without an opening one.
    """
    pattern = rf"</?{tag}(?=[\s/>])[^>]*>"
    tags = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        tags, F.slice(F.split(html, pattern), F.lit(2), F.size(tags)),
        lambda t, after: F.struct(t.alias("tag"), after.alias("after")),
    )

    def step(state: Column, piece: Column) -> Column:
        depth, text, found, mark = state["depth"], state["text"], state["found"], piece["tag"]
        closing, empty = mark.startswith("</"), mark.endswith("/>")
        below = F.when(closing, F.greatest(depth - 1, F.lit(0))).when(empty, depth).otherwise(depth + 1)
        ends = F.when(closing, depth == 1).otherwise(empty & (depth == 0))
        kept = F.when((depth > 0) & ~ends, F.concat(text, mark)).otherwise("")
        return F.struct(
            below.alias("depth"),
            F.when(below > 0, F.concat(kept, piece["after"])).otherwise("").alias("text"),
            F.when(ends, F.array_append(found, text)).otherwise(found).alias("found"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(pieces, start, step, lambda state: state["found"])


def element(html: Column, tag: str, **attributes: str) -> Column:
    """Inner HTML of the first such element, null if there is none."""
    start = opening(tag, **attributes)
    rest = extract(html, rf"(?s){start}.*", 0)
    # Up to the first closing tag in whole runs of text, not by characters; possessive, so long ones take no stack.
    inner = rf"(?:[^<]+|<(?!/{tag}\s*>))*+"
    return let(
        extract(html, rf"{start}({inner})</{tag}\s*>"),
        lambda short: F.when(
            short.contains(f"<{tag}") & short.rlike(rf"<{tag}[\s/>]"), F.coalesce(F.get(outermost(rest, tag), F.lit(0)), short)
        ).otherwise(short),
    )


def items(html: Column) -> Column:
    """The result items of a page, in page order, without what follows their closing tag."""
    parts = F.split(html, opening("li", class_=ITEM_CLASS))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.coalesce(F.get(outermost(F.concat(F.lit("<li>"), p), "li"), F.lit(0)), p))


def hits(html: Column) -> Column:
    """Number of results that the page reports."""
    return thousands_to_int(markup_text(element(html, "span", class_=HITS_CLASS)))


def title(item: Column) -> Column:
    return markup_text(element(item, "span", class_=TITLE_CLASS))


def url(item: Column) -> Column:
    link = extract(element(item, "span", class_=TITLE_CLASS), r"<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']")
    return F.concat(F.lit(SITE), link)


def authors(item: Column) -> Column:
    """First span of every list entry; no list gives null."""
    entries = outermost(element(item, "ul", class_=AUTHORS_CLASS), "li")
    names = F.transform(entries, lambda e: markup_text(element(e, "span"), ""))
    return comma_list(F.filter(names, lambda n: n.isNotNull()))


def date_text(item: Column) -> Column:
    return markup_text(element(item, "div", class_=DATE_CLASS))


def date(text: Column) -> Column:
    """``June 2020`` to ``Jun 2020``; null unless there are two words."""
    return let(
        F.split(trimmed(text), r"\s+"),
        lambda w: F.when(F.size(w) >= 2, F.concat_ws(" ", F.left(w[0], F.lit(3)), w[1])),
    )


def year(text: Column) -> Column:
    """First number of exactly four digits."""
    return extract(text, YEAR_PATTERN, 0).try_cast("int")


def journal(item: Column) -> Column:
    return markup_text(element(item, "span", class_=JOURNAL_CLASS))


def doi(item: Column) -> Column:
    return extract(markup_text(element(item, "a", class_=DOI_CLASS)), DOI_PATTERN, 0)


def citation(item: Column) -> Column:
    return markup_text(element(item, "span", class_=CITATION_CLASS))


def detail_abstract(html: Column) -> Column:
    """Abstract of a detail page; null where the page has no abstract section."""
    section = element(html, "section", role="doc-abstract")
    return markup_text(element(section, "div", role="paragraph"), "")
