"""Landed files and pages that Spark derives from the ``documents`` table.

Each document becomes one record in the layout of a library, so that readers
work on input that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflow.runtime import scratch_path, spread_small
from bibflow.schema import EXCLUSION_CATEGORY, IEEE_DROPS
from bibflow.sinks import export_csv


def year() -> Column:
    return F.expr("year(date_add(DATE '1990-01-01', CAST(n_chars % 10000 AS INT)))")


def doi() -> Column:
    return F.expr("concat('10.1000/', source, '.', doc_id)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def escaped(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def filled(template: str, **values: Column) -> Column:
    """``{name}`` in the template becomes the value, which must not be null."""
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(before), values[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def ieee_exports(docs: DataFrame) -> str:
    """Two kinds of export files in one folder; the second has its columns the other way round.

    A file has 10,000 records at most, so larger splits of the table give more files and not larger ones.
    """
    path, docs = scratch_path(docs.sparkSession, "ieee"), spread_small(docs, "doc_id")
    columns = {
        "Document Title": F.concat(F.lit('A "study"; of '), F.col("source")),
        "Authors": F.concat(F.col("lang"), F.lit(" One; "), F.col("source"), F.lit(" Two")),
        "Publication Title": F.col("source"),
        "Publication Year": F.when(F.col("lang") != "es", year().cast("string")),
        "Abstract": F.col("text"),
        "DOI": doi(),
        "Article Citation Count": F.col("n_chars").cast("string"),
        "PDF Link": F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")),
        "Author Keywords": F.concat(F.lit("a; "), F.col("lang")),
        **{name: F.lit("-") for name in IEEE_DROPS},
        "Document Number": F.col("doc_id").cast("string"),
    }
    selected = [value.alias(name) for name, value in columns.items()]
    export_csv(docs.where("lang = 'en'").select(*selected), path, ",", file_rows=10_000)
    export_csv(docs.where("lang <> 'en'").select(*reversed(selected)), path, ",", mode="append", file_rows=10_000)
    return path


_ARTICLE = """<PubmedArticle><MedlineCitation><PMID Version="1">{id}</PMID><Article><Journal>\
<JournalIssue><PubDate><Year>{year}</Year>{month}</PubDate></JournalIssue><Title>J &amp; {source}</Title></Journal>\
<ArticleTitle>On <i>{lang} <sup>2</sup></i> where p &lt;0.05 and n&gt;3</ArticleTitle>\
<Abstract><AbstractText Label="AIM/OBJECTIVE">From <b>{source}</b>.</AbstractText>\
<AbstractText>{text}</AbstractText><CopyrightInformation>All rights</CopyrightInformation></Abstract>\
<AuthorList>{authors}<Author><CollectiveName>Group</CollectiveName></Author></AuthorList>\
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType></PublicationTypeList></Article>\
{keywords}</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">{id}</ArticleId>{doi}</ArticleIdList>\
<ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/cited</ArticleId></ArticleIdList></Reference>\
</ReferenceList></PubmedData></PubmedArticle>"""

_BOOK = """<PubmedBookArticle><BookDocument><PMID Version="1">{id}</PMID><ArticleIdList>\
<ArticleId IdType="doi">{doi}</ArticleId></ArticleIdList><Book><PubDate><Year>{year}</Year></PubDate></Book>\
<ArticleTitle>Chapter {id}</ArticleTitle><AuthorList><Author><LastName>{source}</LastName><ForeName>Ed</ForeName>\
</Author></AuthorList><Abstract><AbstractText>{text}</AbstractText></Abstract></BookDocument></PubmedBookArticle>"""


def file_count(df: DataFrame, rows: int) -> int:
    """Files of about ``rows`` rows, 16 at least."""
    return max(16, df.count() // rows)


def in_files(rows: DataFrame, key: str, first: str, last: str | None, files: int) -> str:
    """Lines (``value``) in files by hash of ``key``, each between the lines ``first`` and ``last``."""
    path = scratch_path(rows.sparkSession, "lines")
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"), "value")
    ends = [(0, first)] + ([(2, last)] if last is not None else [])
    around = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(v).alias("value")) for p, v in ends]))
    around = rows.select("file").distinct().select("file", around.alias("e")).select("file", "e.*")
    (
        rows.unionByName(around)
        .repartition("file").sortWithinPartitions("file", "place").select("file", "value")
        .write.partitionBy("file").text(path)
    )
    return f"{path}/*"


def search_answers(docs: DataFrame, span: int = 500) -> str:
    """An answer per source and ``span`` document ids: the number of its documents, and their ids."""
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: tag("Id", d.cast("string"))), "")
    answers = docs.groupBy("source", F.floor(F.col("doc_id") / span).alias("range")).agg(
        tag("eSearchResult", F.concat(tag("Count", F.count("*").cast("string")), tag("IdList", ids))).alias("value"))
    return in_files(answers, "value", "<Answers>", "</Answers>", file_count(docs, span * 1000))


def search_pages(docs: DataFrame, search: int = 1000, page: int = 50) -> str:
    """Searches of ``search`` documents in pages of ``page``: every seventh page is missing, every fifth comes twice,
    and every eleventh reports a hit more. The number of files follows that of pages."""
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body.cast("string"), F.lit(f"</{name}>"))
    number = F.floor(F.col("doc_id") % search / page).alias("number")
    rows = docs.groupBy(F.floor(F.col("doc_id") / search).alias("search"), number).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda d: tag("Id", d)), "")
    total = F.lit(search) + (F.col("number") % 11 == 10).cast("int")
    value = tag("eSearchResult", F.concat(
        tag("Count", total), tag("RetMax", F.size("ids")), tag("RetStart", F.col("number") * page), tag("QueryKey", F.lit("1")),
        tag("WebEnv", F.concat(F.lit("S"), F.col("search"))), tag("IdList", ids)))
    times = F.when(F.col("number") % 7 == 3, 0).when(F.col("number") % 5 == 1, 2).otherwise(1)
    copies = F.explode(F.array_repeat(value, times)).alias("value")
    files = file_count(docs, page * 1000)  # some thousand pages a file
    return in_files(rows.select("search", "number", copies), "value", "<Answers>", "</Answers>", files)


def pubmed_files(docs: DataFrame, broken: bool = False) -> str:
    """XML files of 200 to 5,000 records, the more the larger the table: Spanish documents as book chapters, the others as articles.

    With ``broken``, files have 200 records and every third one has a record that is cut off.
    """
    span = 200 if broken else min(5000, max(200, docs.count() // 16))
    path, docs = scratch_path(docs.sparkSession, "pubmed"), spread_small(docs, "doc_id")
    own_doi = filled('<ArticleId IdType="doi">{doi}</ArticleId>', doi=doi())
    author = filled(
        "<Author><LastName>{source}</LastName><ForeName>{lang}</ForeName></Author>",
        source=F.col("source"), lang=F.col("lang"),
    )
    keywords = filled(
        '<KeywordList Owner="N"><Keyword MajorTopicYN="N">k <i>{lang}</i></Keyword><Keyword>{source}</Keyword>'
        "</KeywordList><KeywordList><Keyword>second list</Keyword></KeywordList>",
        lang=F.col("lang"), source=F.col("source"),
    )
    common = {"id": F.col("doc_id"), "year": year(), "source": F.col("source"), "text": escaped(F.col("text"))}
    article = filled(
        _ARTICLE,
        lang=F.col("lang"),
        month=F.when(F.col("lang") == "en", "<Month>Mar</Month>").otherwise(""),
        authors=F.when(F.col("lang") != "fr", author).otherwise(""),
        keywords=F.when(F.col("lang") != "de", keywords).otherwise(""),
        doi=F.when(F.col("source") != "src3", own_doi).otherwise(""),
        **common,
    )
    book = filled(_BOOK, doi=doi(), **common)
    record = F.when(F.col("lang") == "es", book).otherwise(article)
    batches = docs.select(
        F.floor(F.col("doc_id") / span).cast("bigint").alias("batch"), F.lit(1).alias("place"), record.alias("value")
    )
    cut = F.when(F.lit(broken) & (F.col("batch") % 3 == 1), "<PubmedArticle><MedlineCitation><PMID>9</PMID>").otherwise("")
    ends = F.explode(F.array(*[
        F.struct(F.lit(place).alias("place"), tag.alias("value"))
        for place, tag in [(0, F.lit("<PubmedArticleSet>")), (2, F.concat(cut, F.lit("</PubmedArticleSet>")))]
    ]))
    around = batches.select("batch").distinct().select("batch", ends.alias("e")).select("batch", "e.*")
    (
        batches.unionByName(around)
        .repartition("batch")
        .sortWithinPartitions("batch", "place")
        .drop("place")
        .write.partitionBy("batch")
        .text(path)
    )
    return f"{path}/*"


_ITEM = """<li class="search__item issue-item-container"><div class="issue-item__content">\
<h5><span class="x hlFld-Title y"><a href="/doi/{id}">The <i>{lang}</i>&nbsp;&#8211; {source}</a></span></h5>\
<ul class="rlist--inline loa truncate-list"><li><a><span>Ann <b>{lang}</b></span></a></li>\
<li><a><span>Bo &amp; {source}</span></a><span>not a name</span></li></ul>\
<div class="bookPubDate simple-tooltip__block--b">{date}</div>{journal}\
<a class="issue-item__doi dot-separator" href="#">https://doi.org/{doi}</a>\
<span class="citation"><i></i> <span>{cites}</span></span></div></li>"""


def _by_page(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` dealt out by ``page_id`` for grouping, about 10,000 to a partition, with four partitions for each core at least.

    Pages are small and costly to parse; Spark merges the partitions of a plain grouping by their bytes into a few.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(4 * cores, docs.count() // 10_000), "page_id")


def listing_pages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result pages of 20 items, and detail pages for all but the French documents."""
    table, docs = docs, spread_small(docs, "doc_id")
    item = filled(
        _ITEM,
        id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"), doi=doi(), cites=F.col("n_chars"),
        date=F.when(F.col("lang") == "de", year().cast("string")).otherwise(F.concat(F.lit("June "), year())),
        journal=F.when(
            F.col("lang") == "en",
            F.concat(F.lit('<span class="epub-section__title">Proc. '), "source", F.lit("</span>")),
        ).otherwise(""),
    )
    pages = (
        _by_page(docs.withColumn("page_id", F.floor(F.col("doc_id") / 20).cast("bigint")), table)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))
        .select(
            "page_id",
            F.concat(F.lit("https://example.org/page/"), F.col("page_id").cast("string")).alias("url"),
            F.concat(
                F.lit('<p><span class="result hitsLength"> 1,'), F.lpad(F.size("items").cast("string"), 3, "0"),
                F.lit("</span></p><ul>"),
                F.array_join(F.transform("items", lambda i: i["item"]), "\n"), F.lit("</ul>"),
            ).alias("html"),
        )
    )
    detail = filled(
        '<html><!-- <p> --><section role="doc-abstract"><h2>Abstract</h2><div role="paragraph"> {text} </div>'
        '<div role="paragraph">more</div></section></html>',
        text=escaped(F.col("text")),
    )
    details = docs.where("lang <> 'fr'").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://dl.acm.org/doi/"), F.col("doc_id").cast("string")).alias("url"),
        detail.alias("html"),
    )
    return pages, details


_NESTED_ITEM = """<li class="search__item issue-item-container"><div><ul class="tools"><li>save</li>\
<li>share<ul><li>mail</li></ul></li></ul>\
<h5><span class="hlFld-Title"><span>On</span> <a href="/doi/{id}"><span class="hl">{lang}</span> and <span>{source}</span></a></span></h5>\
<ul class="rlist--inline loa truncate-list"><li><span>Ann <span>{lang}</span></span><ul><li><span>mail</span></li></ul></li>\
<li><span>Bo</span></li></ul><div class="bookPubDate simple-tooltip__block--b"><div>June</div><div>{year}</div></div>\
<span class="epub-section__title"><span>Proc.</span> {source} <span>vol</span> 1</span>{cites}</div></li>"""


def nested_pages(docs: DataFrame) -> DataFrame:
    """Result pages whose elements hold others of their own name; German items have no count, the page's end has one."""
    cites = F.when(F.col("lang") == "de", "").otherwise(
        F.concat(F.lit('<span class="citation"><span><span>'), F.col("n_chars").cast("string"), F.lit("</span></span></span>")))
    item = filled(_NESTED_ITEM, id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"), year=year(), cites=cites)
    items = spread_small(docs, "doc_id").select(F.floor(F.col("doc_id") / 20).cast("bigint").alias("page_id"), "doc_id", item.alias("item"))
    return _by_page(items, docs).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items")).select(
        "page_id",
        F.concat(F.lit("<ul>"), F.array_join(F.transform("items", lambda i: i["item"]), "\n"),
                 F.lit('</ul><div><span class="citation">all of them</span></div>')).alias("html"),
    )


def export_folder(docs: DataFrame, rows: int = 200) -> str:
    """A folder of exports: a run per ``rows`` documents, of four shapes of columns."""
    path, docs = scratch_path(docs.sparkSession, "exports"), spread_small(docs, "doc_id")
    run, columns = F.floor(F.col("doc_id") / rows).cast("bigint"), {
        "article_id": F.col("doc_id"), "year": F.expr("concat(2000 + n_chars % 20, '.0')"), "doi": F.col("text"),
        "note": F.lit("n"), "title": F.col("lang"), "Year": F.expr("concat(2000 + n_chars % 20, '.0')"), "DOI": F.col("text"),
    }
    shapes = [["article_id", "year", "doi"], ["doi", "note", "article_id", "year"], ["year", "article_id", "doi", "title"], ["DOI", "Year", "article_id"]]
    for place, names in enumerate(shapes):
        shape = docs.where(run % len(shapes) == place).select(
            F.concat(run.cast("string"), F.lit(".csv")).alias("run"), *[columns[n].alias(n) for n in names])
        shape.repartition("run").write.partitionBy("run").mode("append").options(
            header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def answers(docs: DataFrame) -> DataFrame:
    """Landed answers of a service, two in four languages being error pages."""
    failed = F.lit("<ERROR>An error occurred while processing request. ")
    value = (
        F.when(F.col("lang") == "de", F.concat(failed, F.lit("Details:\n  backend "), "source", F.lit("</ERROR>")))
        .when(F.col("lang") == "fr", F.concat(failed, F.lit("</ERROR>")))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", value.alias("value"))


def strategy_files(turns: DataFrame) -> str:
    """One strategy per conversation: a category per role, a term per turn, system turns as exclusion.

    Files hold many strategies, each named by an attribute.
    """
    path = scratch_path(turns.sparkSession, "strategies")
    role = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    name = F.when(F.col("role") == "system", EXCLUSION_CATEGORY).otherwise(F.col("role"))
    lines = turns.select(
        F.col("conv_id").alias("search_id"), role.alias("category"), F.lit(1).alias("part"), "turn",
        F.concat(F.lit("<Term>"), escaped(F.col("text")), F.lit("</Term>")).alias("value"),
    )
    opened = turns.select(
        F.col("conv_id").alias("search_id"), role.alias("category"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("turn"),
        F.concat(F.lit('<Category name="'), name, F.lit('"><SearchTerms>')).alias("value"),
    ).distinct()
    closed = opened.withColumns({"part": F.lit(2), "value": F.lit("</SearchTerms></Category>")})
    name = F.concat(F.lit('<SearchConfig><Categories search_id="'), F.col("search_id").cast("string"), F.lit('">'))
    ends = F.explode(F.array(*[
        F.struct(F.lit(place).alias("category"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("turn"), tag.alias("value"))
        for place, tag in [(0, name), (9, F.lit("</Categories></SearchConfig>"))]
    ]))
    around = opened.select("search_id").distinct().select("search_id", ends.alias("e")).select("search_id", "e.*")
    file = F.pmod(F.xxhash64("search_id"), F.lit(file_count(turns, 100_000))).cast("int").alias("file")
    rows = lines.unionByName(opened).unionByName(closed).unionByName(around).select(file, F.lit(1).alias("place"), "*")
    root = F.explode(F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(tag).alias("value")) for place, tag in [(0, "<Strategies>"), (2, "</Strategies>")]]))
    roots = rows.select("file").distinct().select("file", root.alias("r")).select("file", "r.*")
    (
        rows.unionByName(roots, allowMissingColumns=True)
        .repartition("file")
        .sortWithinPartitions("file", "place", "search_id", "category", "part", "turn")
        .select("file", "value")
        .write.partitionBy("file")
        .text(path)
    )
    return path


def syntax_files(turns: DataFrame, syntax: list[tuple]) -> str:
    """The syntax of every database, given as rows of ``bibflow.schema.SYNTAX``, once per conversation as the search it holds for."""
    databases: dict[str, dict[str, list]] = {}
    for database, kind, _, position, value in sorted(syntax, key=lambda row: row[2]):
        databases.setdefault(database, {}).setdefault(kind, []).append((position, value))
    body = "".join(
        f'<Database name="{database}">' + "".join(
            f'<Syntax name="{kind}">' + "".join(f'<Term position="{at}">{value}</Term>' for at, value in parts) + "</Syntax>"
            for kind, parts in kinds.items()) + "</Database>"
        for database, kinds in databases.items())
    start = F.concat(F.lit('<Databases search_id="'), F.col("search_id").cast("string"), F.lit('">'))
    rows = turns.select(F.col("conv_id").alias("search_id")).distinct().select("search_id", F.concat(start, F.lit(body + "</Databases>")).alias("value"))
    return in_files(rows, "search_id", "<Syntaxes>", "</Syntaxes>", file_count(turns, 100_000))


def settings_files(turns: DataFrame) -> str:
    """INI files of many searches, with a section for each conversation: a search type per role, among other sections."""
    name = F.when(F.col("role") == "system", EXCLUSION_CATEGORY).otherwise(F.initcap("role"))
    kind = F.when(F.col("role") == "assistant", "_search_type = title").otherwise("_search_type: Title/Abstract")
    lines = F.array_join(F.array_sort(F.collect_set(F.concat(name, kind))), "\n")
    start = F.concat(F.lit("[search "), F.coalesce(F.col("search_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("]\n; types\n"))
    body = F.concat(start, lines, F.lit("\n[output]\nother_search_type = none"))
    settings = turns.groupBy(F.col("conv_id").alias("search_id")).agg(body.alias("value"))
    general = "[general]\nuser_search_type = none\n"
    return in_files(settings, "value", general, None, file_count(turns, 100_000))


def mixed_folder(docs: DataFrame) -> str:
    """One folder of three formats; the delimited files have their columns in another order than the others."""
    path, kept = scratch_path(docs.sparkSession, "mixed"), docs.select("doc_id", "source", "text")
    export_csv(kept.where("lang = 'en'").select("text", "doc_id", "source"), path, ",")
    kept.where("lang NOT IN ('en', 'de')").write.mode("append").parquet(path)
    options = dict(sep="\t", header=True, escape='"', extension="tsv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    kept.where("lang = 'de'").drop("source").write.mode("append").options(**options).csv(path)
    return path
