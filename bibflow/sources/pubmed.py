"""PubMed records landed as XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflow.functions import pubmed as fields
from bibflow.functions.text import extract, in_natural_order, thousands_to_int
from bibflow.runtime import materialise
from bibflow.schema import ARTICLE_COLUMNS, PUBMED_ARTICLE, PUBMED_BOOK

# How the service says that a request failed.
ERROR_TEXT = "An error occurred while processing request"
# Java's dot stops at more line ends than a line feed.
ERROR_DETAILS = r"Details:\s*([^\n]*?)(?:</|$)"
MALFORMED = "not well-formed XML"
NO_DETAILS = "No 'Details' found."


def _article(record: Column) -> Column:
    citation, article = record["MedlineCitation"], record["MedlineCitation"]["Article"]
    return _fields(
        pmid=citation["PMID"]["_VALUE"],
        title=article["ArticleTitle"],
        authors=article["AuthorList"],
        issued=article["Journal"]["JournalIssue"]["PubDate"],
        journal=article["Journal"]["Title"],
        ids=record["PubmedData"]["ArticleIdList"]["ArticleId"],
        abstract=article["Abstract"],
        keywords=citation["KeywordList"],
        types=article["PublicationTypeList"]["PublicationType"],
    )


def _book(record: Column) -> Column:
    doc = record["BookDocument"]
    none = F.array().cast("array<struct<_IdType:string,_VALUE:string>>")
    people = F.array().cast("array<struct<Author:array<struct<ForeName:string,LastName:string>>>>")
    return _fields(
        pmid=doc["PMID"]["_VALUE"],
        title=doc["ArticleTitle"],
        authors=F.concat(F.coalesce(doc["Book"]["AuthorList"], people), F.coalesce(doc["AuthorList"], people)),
        issued=doc["Book"]["PubDate"],
        journal=F.lit(None).cast("string"),
        ids=F.concat(
            F.coalesce(doc["ArticleIdList"]["ArticleId"], none),
            F.coalesce(record["PubmedBookData"]["ArticleIdList"]["ArticleId"], none),
        ),
        abstract=doc["Abstract"],
        keywords=doc["KeywordList"],
        types=doc["PublicationType"],
    )


def _fields(**raw: Column) -> Column:
    columns = {
        "source": F.lit("PubMed"),
        "title": fields.title(raw["title"]),
        "authors": fields.authors(raw["authors"]),
        "date": fields.date(raw["issued"]),
        "year": fields.year(raw["issued"]),
        "journal_book": raw["journal"],
        "doi": fields.first_id(raw["ids"], "doi"),
        "pmid": raw["pmid"],
        "url": fields.url(fields.first_id(raw["ids"], "pubmed")),
        "abstract": fields.abstract(raw["abstract"]),
        "keywords": fields.keywords(raw["keywords"]),
        "citation": F.lit(None).cast("string"),
    }
    return F.struct(
        *[columns[c].alias(c) for c in ARTICLE_COLUMNS], fields.first_type(raw["types"]).alias("publication_type"))


# The elements that hold a record. A set of articles has a longer name.
_START = r"<Pubmed(?:Book)?Article(?=[\s>])"
_RECORD = r"(?s)^<(Pubmed(?:Book)?Article)(?=[\s>]).*</\1\s*>"
_CORRUPT = "_corrupt_record"


def _parsed(record: Column, schema: str) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return F.from_xml(record, f"{schema}, {_CORRUPT} STRING", options)


def _routed(bodies: DataFrame, file: Column | None = None) -> DataFrame:
    """Every record of whole landed files (``value``), and every fault, with its ``details``, out of one pass.

    A file is cut where records start, and each piece is read by itself: as article, as book, or as
    a fault if it is cut off or not well formed. What stands before the first record may hold the service's error.
    """
    file = F.col("_metadata.file_path") if file is None else file
    pieces = bodies.select(
        in_natural_order(file).alias("ingest_file"), file.alias("ingest_path"),
        F.posexplode(F.split("value", f"(?={_START})")).alias("ingest_seq", "piece"))
    record = F.regexp_extract("piece", _RECORD, 0)
    starts = F.col("piece").rlike(f"^{_START}")
    failed = ~starts & F.col("piece").contains(ERROR_TEXT)
    book = starts & F.col("piece").startswith("<PubmedBook")
    read = pieces.where(starts | failed).select(
        "ingest_file", "ingest_path", book.cast("int").alias("record_kind"), F.col("ingest_seq").cast("bigint").alias("ingest_seq"),
        # Arrays of one, taken apart again, so that no later filter has a record parsed twice.
        F.inline(F.array(F.struct(
            F.when(starts & ~book & (record != ""), _parsed(record, PUBMED_ARTICLE)).alias("article"),
            F.when(book & (record != ""), _parsed(record, PUBMED_BOOK)).alias("book"),
            F.when(failed, F.coalesce(extract(F.col("piece"), ERROR_DETAILS), F.lit(NO_DETAILS)))
            .when(record == "", MALFORMED).alias("fault")))))
    corrupt = F.coalesce(F.col("article")[_CORRUPT], F.col("book")[_CORRUPT]).isNotNull()
    return read.select(
        "ingest_file", "ingest_path", "record_kind", "ingest_seq", "article", "book",
        F.coalesce("fault", F.when(corrupt, MALFORMED)).alias("details"))


_PLACE = ("ingest_file", "ingest_path", "record_kind", "ingest_seq")


def _records(routed: DataFrame) -> DataFrame:
    fields_ = F.when(F.col("record_kind") == 0, _article(F.col("article"))).otherwise(_book(F.col("book")))
    return routed.select(*_PLACE, fields_.alias("record")).select(*_PLACE, "record.*")


def _sound(routed: DataFrame) -> DataFrame:
    """Only records; a fault stops the job."""
    stop = F.raise_error(F.concat(F.lit("malformed record in "), "ingest_path", F.lit(": "), "details")).cast("boolean")
    return routed.where(F.when(F.col("details").isNotNull(), stop).otherwise(True))


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Articles (``record_kind`` 0) and book chapters (1) of every file in a folder.

    Files are UTF-8 and each is read whole by one task, so land files of moderate size, some tens
    of MB. A record that is cut off or not well formed stops the job, and so does a landed error
    answer; ``split_malformed`` sets them apart.
    """
    return _records(_sound(_routed(spark.read.text(path, wholetext=True))))


def split_malformed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sound records of all files, and ``file``, ``place`` and ``details`` of what is not one.

    Faults are single records that are cut off or not well formed, and error answers. The files are read once.
    """
    routed = materialise(_routed(spark.read.text(path, wholetext=True)), "records")
    bad = routed.where("details IS NOT NULL").select(
        F.col("ingest_path").alias("file"), F.col("ingest_seq").alias("place"), "details")
    return _records(routed.where("details IS NULL")), bad


def read_search_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers to searches: ``file``, the ``total`` hits it reports, and ``position`` and ``pmid`` of each id.

    An answer without ids has one row with null for both.
    """
    schema = "Count STRING, IdList STRUCT<Id: ARRAY<STRING>>"
    answers = spark.read.format("xml").option("rowTag", "eSearchResult").option("mode", "FAILFAST").schema(schema).load(path)
    return answers.select(
        F.col("_metadata.file_path").alias("file"),
        thousands_to_int(F.col("Count")).alias("total"),
        F.posexplode_outer("IdList.Id").alias("position", "pmid"),
    )


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of searches whose ids were fetched some at a time, one row per id.

    ``search`` (the service's session and key), the ``total`` hits that the page reports, ``start``, its place
    in the whole answer, ``size``, how many ids it has, and ``position`` and ``pmid`` of each id. A page without ids has one
    row with null for both.
    """
    schema = "Count STRING, RetStart STRING, QueryKey STRING, WebEnv STRING, IdList STRUCT<Id: ARRAY<STRING>>"
    pages = spark.read.format("xml").option("rowTag", "eSearchResult").option("mode", "FAILFAST").schema(schema).load(path)
    ids = F.coalesce(F.col("IdList.Id"), F.array().cast("array<string>"))
    return pages.select(
        F.concat_ws("/", "WebEnv", "QueryKey").alias("search"),
        thousands_to_int(F.col("Count")).cast("bigint").alias("total"),
        thousands_to_int(F.col("RetStart")).cast("bigint").alias("start"),
        F.size(ids).cast("bigint").alias("size"),
        F.posexplode_outer(ids).alias("position", "pmid"),
    )


def read_pubmed_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same records as a stream of newly landed files."""
    return parse_bodies(stream_bodies(spark, path, files_per_batch))


def stream_bodies(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Newly landed files as a stream, whole (``value``) and with their ``ingest_path``."""
    bodies = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return bodies.select("value", F.col("_metadata.file_path").alias("ingest_path"))


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """The records of whole files as ``stream_bodies`` gives them; a fault stops the job."""
    return _records(_sound(_routed(bodies, F.col("ingest_path"))))


def split_errors(bodies: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """Landed answers without and with the service's error text.

    The second table has ``details``, what the service gave as reason.
    """
    failed = F.coalesce(F.col(body).contains(ERROR_TEXT), F.lit(False))
    details = F.coalesce(extract(F.col(body), ERROR_DETAILS), F.lit(NO_DETAILS))
    return bodies.where(~failed), bodies.where(failed).withColumn("details", details)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed files: ``file`` and ``value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
