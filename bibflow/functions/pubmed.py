"""Fields of PubMed records, on columns read with the schemas in ``bibflow.schema``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibflow.functions.text import comma_list, strip_inline, title_case, trimmed

# Fixed value: address of a PubMed record.
RECORD_URL = "https://pubmed.ncbi.nlm.nih.gov/"


def authors(lists: Column) -> Column:
    """``"Fore Last"`` of every person; groups are left out and nobody gives ``''``."""
    people = F.filter(
        F.flatten(F.transform(lists, lambda l: l["Author"])),
        lambda a: a["ForeName"].isNotNull() & a["LastName"].isNotNull(),
    )
    names = F.transform(people, lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"]))
    return F.coalesce(comma_list(names), F.lit(""))


def date(pub_date: Column) -> Column:
    """``"Mon YYYY"`` where both are known."""
    both = pub_date["Month"].isNotNull() & pub_date["Year"].isNotNull()
    return F.when(both, F.concat_ws(" ", pub_date["Month"], pub_date["Year"]))


def year(pub_date: Column) -> Column:
    return pub_date["Year"].try_cast("int")


def keywords(lists: Column) -> Column:
    """Keywords of the first list; no list gives null."""
    return strip_inline(comma_list(F.try_element_at(lists, F.lit(1))["Keyword"]))


def first_id(ids: Column, kind: str) -> Column:
    """First identifier of the given kind."""
    found = F.filter(ids, lambda i: i["_IdType"] == kind)
    return F.try_element_at(found, F.lit(1))["_VALUE"]


def url(pubmed_id: Column) -> Column:
    return F.concat(F.lit(RECORD_URL), pubmed_id, F.lit("/"))


def title(article_title: Column) -> Column:
    return strip_inline(article_title)


def first_type(types: Column) -> Column:
    return F.try_element_at(types, F.lit(1))["_VALUE"]


def abstract(body: Column) -> Column:
    """All abstract parts in order, each behind its label; no abstract gives ``''``."""
    pattern = r"(?s)<AbstractText([^>]*?)(?:/>|>(.*?)</AbstractText>)"
    attributes = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))

    def part(attrs: Column, text: Column) -> Column:
        label = F.regexp_extract(attrs, r'\bLabel="([^"]*)"', 1)
        prefix = F.when(label != "", F.concat(title_case(label), F.lit(": "))).otherwise("")
        return F.concat(prefix, trimmed(strip_inline(text)))

    parts = F.filter(F.zip_with(attributes, texts, part), lambda p: p != "")
    return F.coalesce(F.array_join(parts, " "), F.lit(""))
