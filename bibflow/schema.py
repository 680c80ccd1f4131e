"""Table layouts and run parameters."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from pyspark.sql import types as T

# Names and order of the article table.
ARTICLE_COLUMNS = [
    "source", "title", "authors", "date", "year", "journal_book",
    "doi", "pmid", "url", "abstract", "keywords", "citation",
]

ARTICLES = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "year" else T.StringType()) for c in ARTICLE_COLUMNS]
)

# Where a record was found, which gives its place in arrival order: by landed
# file, in a file articles before books, then by place in the file.
INGEST_ORDER = ["ingest_file", "record_kind", "ingest_seq"]
INGEST = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ingest_file", T.StringType()),
    T.StructField("record_kind", T.IntegerType()),
    T.StructField("ingest_seq", T.LongType()),
])

# Source labels, in the order in which a run lists them.
SOURCES = ["IEEE", "PubMed", "ACM"]

# Columns of an IEEE export that carry over, and their new names.
IEEE_RENAMES = {
    "Document Title": "title",
    "Authors": "authors",
    "Publication Title": "journal_book",
    "Publication Year": "year",
    "Abstract": "abstract",
    "DOI": "doi",
    "Article Citation Count": "citation",
    "PDF Link": "url",
    "Author Keywords": "keywords",
}

# Columns of an IEEE export that are left out. All must be there.
IEEE_DROPS = [
    "Author Affiliations", "Date Added To Xplore", "Volume", "Issue",
    "Start Page", "End Page", "ISSN", "ISBNs", "Funding Information",
    "IEEE Terms", "Mesh_Terms", "Patent Citation Count", "Reference Count",
    "License", "Online Date", "Issue Date", "Meeting Date", "Publisher",
    "Document Identifier",
]

# Fixed value: the one category name that excludes.
EXCLUSION_CATEGORY = "exclusion_category"

TERMS = (
    "search_id STRING, category STRING, category_pos INT, "
    "is_exclusion BOOLEAN, term_pos INT, term STRING"
)
SYNTAX = "database STRING, search_type STRING, syntax_pos INT, position STRING, text STRING"
SEARCH_TYPES = "search_id STRING, category STRING, search_type STRING"

# Which article columns each search type looks at.
SEARCH_FIELDS = {
    "title": ["title"],
    "title/abstract": ["title", "abstract"],
    "title/abstract/keyword": ["title", "abstract", "keywords"],
    "fulltext": ["title", "abstract", "keywords", "authors", "journal_book"],
}

# PubMed records, read with every leaf as text: an element with inline markup
# stays whole, and one bad value cannot blank the fields after it.
_IDS = "STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>"
_AUTHORS = "ARRAY<STRUCT<Author: ARRAY<STRUCT<ForeName: STRING, LastName: STRING>>>>"
_KEYWORDS = "ARRAY<STRUCT<Keyword: ARRAY<STRING>>>"
_DATE = "STRUCT<Year: STRING, Month: STRING>"
_TYPE = "ARRAY<STRUCT<_VALUE: STRING>>"
PUBMED_ARTICLE = f"""
    MedlineCitation STRUCT<
        PMID: STRUCT<_VALUE: STRING>,
        Article: STRUCT<
            Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: {_DATE}>>,
            ArticleTitle: STRING,
            Abstract: STRING,
            AuthorList: {_AUTHORS},
            PublicationTypeList: STRUCT<PublicationType: {_TYPE}>>,
        KeywordList: {_KEYWORDS}>,
    PubmedData STRUCT<ArticleIdList: {_IDS}>
"""
PUBMED_BOOK = f"""
    BookDocument STRUCT<
        PMID: STRUCT<_VALUE: STRING>,
        ArticleIdList: {_IDS},
        Book: STRUCT<PubDate: {_DATE}, AuthorList: {_AUTHORS}>,
        ArticleTitle: STRING,
        AuthorList: {_AUTHORS},
        PublicationType: {_TYPE},
        Abstract: STRING,
        KeywordList: {_KEYWORDS}>,
    PubmedBookData STRUCT<ArticleIdList: {_IDS}>
"""


@dataclass(frozen=True)
class Params:
    """Settings of one run. None means "not set"."""

    start_year: int | None = None
    end_year: int | None = None
    max_results: int | None = None
    screening: str | None = None
    nr_randomizations: int = 25
    database: str | None = None
    seed: int = 42

    @classmethod
    def from_ini(cls, path: str) -> "Params":
        """Read the [search] and [pilot] sections; the text None means not set."""
        ini = configparser.ConfigParser()
        with open(path, encoding="utf-8") as f:
            ini.read_file(f)

        def value(section, name, kind=str):
            text = ini.get(section, name, fallback="None")
            return None if text == "None" else kind(text)

        return cls(
            start_year=value("search", "start_year", int),
            end_year=value("search", "end_year", int),
            max_results=value("search", "max_results", int),
            screening=value("pilot", "screening"),
            nr_randomizations=value("pilot", "nr_randomizations", int) or cls.nr_randomizations,
            database=value("search", "manual_database"),
        )
