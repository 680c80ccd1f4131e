"""Search strategies kept in XML files: categories of terms, and the syntax of databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflow.functions.text import extract
from bibflow.schema import EXCLUSION_CATEGORY

_CATEGORIES = "Category ARRAY<STRUCT<_name: STRING, SearchTerms: STRUCT<Term: ARRAY<STRING>>>>"
_DATABASES = (
    "Database ARRAY<STRUCT<_name: STRING, Syntax: ARRAY<STRUCT<_name: STRING, "
    "Term: ARRAY<STRUCT<_position: STRING, _VALUE: STRING>>>>>>"
)

_NAMED_SECTION = r"^\[search[ \t]+([^\]\s][^\]\n]*?)[ \t]*\]"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", False)
    return reader.option("mode", "FAILFAST").schema(schema).load(path)


def _search_id(extension: str) -> Column:
    """The name of a search, as text: of its folder ``search_id=<name>`` if it has one, else of its file."""
    folder = F.url_decode(F.replace(extract(F.col("_metadata.file_path"), "/search_id=([^/]+)/"), F.lit("+"), F.lit("%2B")))
    return F.coalesce(folder, F.regexp_replace("_metadata.file_name", rf"\.{extension}$", ""))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of every strategy file.

    A search is named by the ``search_id`` of its ``Categories`` element if it
    has one, so that a file can hold many searches; else after its folder
    ``search_id=<name>``, else after its file.
    """
    files = _read(spark, path, "Categories", f"_search_id STRING, {_CATEGORIES}")
    categories = files.select(
        F.coalesce("_search_id", _search_id("xml")).alias("search_id"), F.posexplode("Category").alias("category_pos", "c")
    )
    return categories.select(
        "search_id",
        F.col("c._name").alias("category"),
        "category_pos",
        (F.col("c._name") == EXCLUSION_CATEGORY).alias("is_exclusion"),
        F.posexplode("c.SearchTerms.Term").alias("term_pos", "term"),
    )


def read_syntax(spark: SparkSession, path: str) -> DataFrame:
    """What each database wants before and after a term, per search and search type.

    The reader gives no text for a part that is only blanks; it counts as one.
    """
    return (
        _read(spark, path, "Databases", f"_search_id STRING, {_DATABASES}")
        .select(F.coalesce("_search_id", _search_id("xml")).alias("search_id"), F.explode("Database").alias("d"))
        .select("search_id", F.col("d._name").alias("database"), F.explode("d.Syntax").alias("s"))
        .select("search_id", "database", F.col("s._name").alias("search_type"), F.posexplode("s.Term").alias("syntax_pos", "t"))
        .select(
            "search_id",
            "database",
            "search_type",
            "syntax_pos",
            F.col("t._position").alias("position"),
            F.coalesce("t._VALUE", F.lit(" ")).alias("text"),
        )
    )


def read_search_types(spark: SparkSession, path: str, searches: str | DataFrame | None = None) -> DataFrame:
    """Search types from the ``<category>_search_type`` settings of INI files, in their ``search`` section.

    The first such section of a file holds for the search that the file is named after. A
    section ``[search <name>]`` holds for the search of that name, so that a file can hold many
    searches. With ``searches``, one name or a table with ``search_id``, the settings of one file hold for all of these.
    """
    text = F.regexp_replace("value", r"\r\n?", "\n")
    sections = F.split(text, r"(?:^|\n)(?=\[)")
    own = F.slice(F.filter(sections, lambda s: s.startswith("[search]")), 1, 1)
    of_others = F.filter(sections, lambda s: s.rlike(_NAMED_SECTION))
    settings = spark.read.text(path, wholetext=True).select(
        _search_id("ini").alias("file"), F.explode(F.concat(own, of_others)).alias("section"))
    named = F.nullif(F.regexp_extract("section", _NAMED_SECTION, 1), F.lit(""))
    body = F.regexp_replace("section", r"^[^\n]*\n?", "")
    lines = settings.select(F.coalesce(named, "file").alias("search_id"), F.explode(F.split(body, "\n")).alias("line"))
    setting = r"^([^=:#;\s][^=:]*?)_search_type\s*[=:]\s*(.*?)\s*$"
    types = lines.where(F.lower("line").rlike(setting)).select(
        "search_id", F.regexp_extract(F.lower("line"), setting, 1).alias("category"),
        F.regexp_replace("line", r"^[^=:]*[=:]\s*|\s+$", "").alias("search_type"))
    if searches is None:
        return types
    if isinstance(searches, str):
        return types.withColumn("search_id", F.lit(searches))
    # The settings of one file are a few rows.
    rows = types.select("category", "search_type").distinct().collect()
    pairs = F.array(*[F.struct(F.lit(r[0]).alias("category"), F.lit(r[1]).alias("search_type")) for r in rows])
    pairs = pairs.cast("array<struct<category:string,search_type:string>>")
    return searches.select("search_id").distinct().select("search_id", F.explode(pairs).alias("p")).select("search_id", "p.*")
