"""Registered queries and the SQL that each must equal.

``entry`` runs the flagship query, ``queries`` has one entry per operator on
the supplied tables, and ``oracle_sql`` the same result in SQL. Documents
stand in for articles: the text is title, abstract or DOI as the query needs,
and the source is the run or the library.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflow import runtime, schema, sinks
from bibflow.functions import listing, text
from bibflow.operators import compare, harmonise, render, screen, search
from bibflow.operators.pages import assemble_pages
from bibflow.plans.runs import build_run, screen_runs
from bibflow.plans.skew import Limits
from bibflow.sources import delimited, pubmed
from bibflow.sources import listing as listing_source
from bibflow.sources import strategy
from bibflow.streaming.ingest import ingest_pubmed
from checks import landed
from checks.landed import documents

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its name, with its SQL."""
    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Duplicates and pilot samples

def _duplicates(key: str, per: str = "") -> str:
    return f"""
        SELECT doc_id, source,
               CASE WHEN doi IS NULL OR doi = '' OR count(*) OVER (PARTITION BY {per} doi) > 1
                    THEN 'x' ELSE '' END AS duplicate
        FROM (SELECT doc_id, source, {key} AS doi FROM documents)"""


_MISSING = "CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '' ELSE text END"


@_query(_duplicates("text"))
def mark_duplicates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("doi"))
    return screen.mark_duplicates(docs, run_key=None).drop("doi")


@_query(_duplicates("text", "source,"))
def mark_duplicates_per_run(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("doi"))
    return screen.mark_duplicates(docs, run_key="source").drop("doi")


@_query(_duplicates(_MISSING))
def mark_duplicates_missing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", F.expr(_MISSING).alias("doi"))
    return screen.mark_duplicates(docs, run_key=None).drop("doi")


@_query(_duplicates("text"))
def mark_duplicates_shuffled(spark, sf_dir):
    """The plan for more repeated keys than may be broadcast, with hot keys sliced."""
    docs = documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("doi"))
    limits = Limits(broadcast_keys=0, hot_rows=2)
    return screen.mark_duplicates(docs, run_key=None, limits=limits).drop("doi")


@_query("""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) <= 25
                        THEN 'x' END AS pilot
    FROM documents""")
def pilot_sample(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return screen.pilot_sample(docs, 25, run_key=None, row_id="doc_id")


@_query("""
    SELECT doc_id, source,
           CASE WHEN row_number() OVER (
               PARTITION BY source ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) <= 5
           THEN 'x' END AS pilot
    FROM documents""")
def pilot_per_run(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return screen.pilot_sample(docs, 5, seed=7, run_key="source", row_id="doc_id", strict=False)


@_query("SELECT source, min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents GROUP BY source")
def id_range(spark, sf_dir):
    return screen.id_range(documents(spark, sf_dir), run_key="source", row_id="doc_id")


# One article table

_ORDER_YEAR = "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(year(o_orderdate) AS INT) END"


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_YEAR).alias("year"))


def _years(condition: str) -> str:
    return f"""SELECT * FROM (SELECT o_orderkey, {_ORDER_YEAR} AS year FROM orders)
               WHERE year IS NULL OR {condition}"""


@_query(_years("year BETWEEN 1997 AND 1999"))
def year_between(spark, sf_dir):
    return harmonise.year_between(_orders(spark, sf_dir), 1997, 1999)


@_query(_years("year >= 1998"))
def year_from(spark, sf_dir):
    return harmonise.year_between(_orders(spark, sf_dir), 1998, None)


@_query(_years("year <= 1996"))
def year_until(spark, sf_dir):
    return harmonise.year_between(_orders(spark, sf_dir), None, 1996)


@_query("""
    SELECT doc_id, source, text FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25""")
def cap_per_source(spark, sf_dir):
    return harmonise.cap_per_source(documents(spark, sf_dir).select("doc_id", "source", "text"), 25, ["source"], ["doc_id"])


@_query("""
    SELECT event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 1500""")
def cap_per_source_large(spark, sf_dir):
    """The plan for caps that are too large for a window: a distributed sort of the order columns."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    capped = harmonise.cap_per_source(
        events, 1500, ["event_type"], ["ts", "event_id"], Limits(window_rows=100)
    )
    return capped.drop("ts")


_ARTICLE_SQL = """
    SELECT {source} AS source, {title} AS title, CAST(NULL AS VARCHAR) AS authors, CAST(NULL AS VARCHAR) AS date,
           {year} AS year, CAST(NULL AS VARCHAR) AS journal_book, {doi} AS doi, CAST(NULL AS VARCHAR) AS pmid,
           CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS abstract, {keywords} AS keywords,
           CAST(NULL AS VARCHAR) AS citation
    FROM {table}"""
_NO = "CAST(NULL AS VARCHAR)"


@_query(
    _ARTICLE_SQL.format(
        source="source", title="text", year="CAST(NULL AS INT)", doi="CAST(doc_id AS VARCHAR)", keywords="lang",
        table="documents")
    + " UNION ALL "
    + _ARTICLE_SQL.format(
        source="'benchmark'", title="text", year="CAST(NULL AS INT)", doi=_NO, keywords=_NO, table="benchmark")
    + " UNION ALL "
    + _ARTICLE_SQL.format(
        source="o_orderstatus", title=_NO, year="CAST(year(o_orderdate) AS INT)", doi=_NO, keywords="o_orderpriority",
        table="orders")
)
def union_sources(spark, sf_dir):
    first = documents(spark, sf_dir).selectExpr(
        "source", "text AS title", "CAST(doc_id AS STRING) AS doi", "lang AS keywords", "n_chars")
    second = _table(spark, sf_dir, "benchmark").selectExpr("'benchmark' AS source", "text AS title")
    third = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS keywords", "o_orderstatus AS source", "year(o_orderdate) AS year")
    return harmonise.union_sources(*[harmonise.conform(df) for df in (first, second, third)])


@_query("SELECT page_id, replace(url, '; ', ', ') AS url, replace(html, '; ', ', ') AS html FROM pages")
def harmonise_strings(spark, sf_dir):
    return harmonise.replace_separators(_table(spark, sf_dir, "pages"))


@_query("SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS article_id, doc_id, text FROM documents")
def assign_ids(spark, sf_dir):
    return harmonise.assign_ids(documents(spark, sf_dir).select("doc_id", "text"), [F.col("doc_id").desc()])


@_query("""
    SELECT row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS article_id, doc_id, source, lang
    FROM documents""")
def assign_ids_by_source(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang")
    return harmonise.assign_ids(docs, ["source", "lang", "doc_id"])


@_query("""
    SELECT batch, count(*) AS articles, min(doc_id) AS first_id, max(doc_id) AS last_id
    FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS batch FROM documents)
    GROUP BY batch""")
def batch_numbers(spark, sf_dir):
    numbered = harmonise.assign_ids(documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    return harmonise.batch_numbers(numbered, 200).groupBy("batch").agg(
        F.count("*").alias("articles"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@_query("""
    SELECT source, lang, count(*) AS articles, count(*) - count(doi) AS without_doi, count(*) - count(year) AS without_year
    FROM (SELECT source, lang, CASE WHEN lang <> 'de' THEN text END AS doi,
                 CASE WHEN n_chars > 1000 THEN 2000 END AS year FROM documents)
    GROUP BY source, lang""")
def run_summary(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr(
        "source", "lang", "CASE WHEN lang <> 'de' THEN text END AS doi", "CASE WHEN n_chars > 1000 THEN 2000 END AS year")
    return harmonise.run_summary(docs, ["source", "lang"])


# Two runs: the old one holds all documents, the new one the labelled documents and the benchmark

def _runs(spark, sf_dir, title_old="text", title_new="text", notes="CAST(NULL AS STRING)"):
    docs, labels = documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    old = docs.selectExpr("doc_id AS article_id", "source", f"{title_old} AS title", f"{notes} AS notes")
    found = docs.join(labels, "doc_id").selectExpr("doc_id AS article_id", "source", f"{title_new} AS title", "quality")
    bench = _table(spark, sf_dir, "benchmark").selectExpr("item_id AS article_id", "'benchmark' AS source", "text AS title")
    return old, found.unionByName(bench, allowMissingColumns=True)


def _compared(title_old="text", title_new="text", notes="CAST(NULL AS VARCHAR)") -> str:
    return f"""
        WITH old AS (SELECT doc_id AS article_id, source, {title_old} AS title, {notes} AS notes FROM documents),
        new AS (
            SELECT doc_id AS article_id, source, {title_new} AS title, quality FROM documents JOIN labels USING (doc_id)
            UNION ALL SELECT item_id, 'benchmark', text, NULL FROM benchmark),
        old_titles AS (SELECT DISTINCT title FROM old), new_titles AS (SELECT DISTINCT title FROM new)
        SELECT o.article_id, o.source, o.title,
               CASE WHEN EXISTS (SELECT 1 FROM new_titles n WHERE n.title IS NOT DISTINCT FROM o.title)
                    THEN o.notes ELSE 'Remove' END AS notes,
               CAST(NULL AS INT) AS quality, 0 AS side
        FROM old o
        UNION ALL
        SELECT n.article_id, n.source, n.title, 'Add', n.quality, 1
        FROM new n
        WHERE NOT EXISTS (SELECT 1 FROM old_titles o WHERE o.title IS NOT DISTINCT FROM n.title)"""


@_query(_compared())
def compare_runs(spark, sf_dir):
    return compare.compare_runs(*_runs(spark, sf_dir), with_side=True)


_NULL_OLD = "CASE WHEN lang <> 'de' THEN text END"
_NULL_NEW = "CASE WHEN toxic = 0 THEN text END"


@_query(_compared(_NULL_OLD, _NULL_NEW))
def compare_null_titles(spark, sf_dir):
    return compare.compare_runs(*_runs(spark, sf_dir, _NULL_OLD, _NULL_NEW), with_side=True)


@_query(_compared("text", _NULL_NEW, "CASE WHEN lang = 'en' THEN 'checked' END"))
def compare_prior_notes(spark, sf_dir):
    """Missing titles in the new run only, prior notes, and the plan for long title lists."""
    limits = Limits(broadcast_keys=0, hot_rows=2)
    old, new = _runs(spark, sf_dir, "text", _NULL_NEW, "CASE WHEN lang = 'en' THEN 'checked' END")
    return compare.compare_runs(old, new, with_side=True, limits=limits)


@_query(f"""
    SELECT row_number() OVER (ORDER BY side, article_id) - 1 AS article_id, article_id AS source_article_id,
           source, title, notes, quality
    FROM ({_compared()})""")
def export_comparison(spark, sf_dir):
    """A comparison written as CSV under new numbers and read back."""
    compared = compare.compare_runs(*_runs(spark, sf_dir), with_side=True)
    # Benchmark items and documents are numbered separately; side 1 only has the former here.
    path = sinks.export_comparison(compared, runtime.scratch_path(spark, "comparison"), "2024-01-02_030405")
    back = delimited.read_table(spark, path, "csv", ";")
    kinds = {"article_id": "bigint", "source_article_id": "bigint", "quality": "int"}
    return back.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in back.columns])


@_query("SELECT doc_id, lang FROM documents WHERE source = (SELECT max(source) FROM documents)")
def select_run(spark, sf_dir):
    runs = documents(spark, sf_dir).selectExpr("doc_id", "lang", "source AS run_id")
    return compare.select_run(runs).drop("run_id")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def restrict_to_ids(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return compare.restrict_to_ids(docs, _table(spark, sf_dir, "labels"), on="doc_id")


@_query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_detail(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return compare.attach_detail(docs, _table(spark, sf_dir, "labels"), on="doc_id")


# Fields of HTML pages

_ENTITIES = "html"
for _name, _char in [("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")]:
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', '{_char}')"


def _decoded(sql: str) -> str:
    return _ENTITIES.replace("html", sql, 1)


@_query(f"""
    SELECT page_id, trim({_decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS title FROM pages""")
def page_title(spark, sf_dir):
    heading = listing.element(F.col("html"), "h1")
    return _table(spark, sf_dir, "pages").select("page_id", text.markup_text(heading).alias("title"))


@_query(r"""
    SELECT page_id, array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), ', ') AS entries
    FROM pages""")
def page_list_join(spark, sf_dir):
    entries = F.regexp_extract_all("html", F.lit(r"(?s)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    names = F.transform(entries, lambda e: text.markup_text(listing.element(e, "a"), ""))
    return _table(spark, sf_dir, "pages").select("page_id", text.comma_list(names).alias("entries"))


@_query(rf"""
    SELECT page_id, array_to_string(list_filter(list_transform(
               string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
                                  '<[^>]+>'),
               lambda p: trim({_decoded("p")}, chr(10) || chr(9) || chr(13) || ' ')), lambda p: p <> ''), ' ') AS content
    FROM pages""")
def page_text(spark, sf_dir):
    pages = runtime.spread_small(_table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", text.markup_text(F.col("html")).alias("content"))


@_query(r"""
    SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host,
           nullif(regexp_extract(url, '(\d+)', 1), '') AS number,
           nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page
    FROM pages""")
def page_url_parts(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        text.extract(url, r"^https?://([^/]+)").alias("host"),
        text.extract(url, r"(\d+)").alias("number"),
        text.extract(url, r"[?&]page=(\d+)").alias("page"),
    )


# Boolean search. Each strategy: categories of (search type, terms), then exclusions

_STRATEGIES = {
    "articles and joins": ([("Title/Abstract", ["the", '"of the"', "die"]), ("title/abstract", ["ing*", "en"])], ["onw*"]),
    "either language": ([("Title/Abstract", ["que", "le", '"sich die"']), ("Title/Abstract", ["é*", "ung*", '"la que"'])], []),
    "signs": ([("Title/Abstract", ["the.", "ent*, and", "die-der"]), ("FullText", ["of", '"re, the"'])], ["a the"]),
    "source": ([("Title", ["src1*"]), ("Title/Abstract/Keyword", ["fr", "de"])], ["es"]),
}
_W, _E = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_FIELDS = {"title": "source", "abstract": "text", "keywords": "lang"}


def _strategy_tables(spark, names):
    terms, types = [], []
    for name in names:
        required, excluded = _STRATEGIES[name]
        groups = [(f"category_{i}", kind, words, False) for i, (kind, words) in enumerate(required, 1)]
        if excluded:
            groups.append((schema.EXCLUSION_CATEGORY, "Title/Abstract", excluded, True))
        for place, (category, kind, words, excludes) in enumerate(groups):
            types.append((name, category, kind))
            terms += [(name, category, place, excludes, i, word) for i, word in enumerate(words)]
    return spark.createDataFrame(terms, schema.TERMS), spark.createDataFrame(types, schema.SEARCH_TYPES)


def _strategy_sql(name: str) -> str:
    required, excluded = _STRATEGIES[name]

    def pattern(word):
        clean = "".join(c if c.isalnum() or c in " *" else "\\" + c for c in word.replace('"', ""))
        return clean.replace("*", f"{_W}*").replace(" ", r"\s+")

    def hit(kind, words):
        columns = [_FIELDS[f] for f in schema.SEARCH_FIELDS[kind.lower()] if f in _FIELDS]
        regex = f"(?:^|{_E})(?:{'|'.join(map(pattern, words))})(?:{_E}|$)"
        return "(" + " OR ".join(f"regexp_matches(lower({c}), '{regex}')" for c in columns) + ")"

    tests = [hit(kind, words) for kind, words in required]
    if excluded:
        tests.append("NOT " + hit("Title/Abstract", excluded))
    return " AND ".join(tests)


def _searched(spark, sf_dir):
    docs = documents(spark, sf_dir).selectExpr("doc_id", "source AS title", "text AS abstract", "lang AS keywords")
    return runtime.spread_small(docs, "doc_id")


@_query(f"SELECT doc_id FROM documents WHERE {_strategy_sql('articles and joins')}")
def boolean_search(spark, sf_dir):
    found = search.boolean_search(_searched(spark, sf_dir), *_strategy_tables(spark, ["articles and joins"]))
    return found.select("doc_id")


@_query(f"SELECT doc_id FROM documents WHERE {_strategy_sql('source')}")
def boolean_search_fields(spark, sf_dir):
    return search.boolean_search(_searched(spark, sf_dir), *_strategy_tables(spark, ["source"])).select("doc_id")


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS search_id FROM documents WHERE {_strategy_sql(name)}" for name in _STRATEGIES
)


@_query(_MATCHES)
def match_searches(spark, sf_dir):
    return search.match_searches(_searched(spark, sf_dir), *_strategy_tables(spark, list(_STRATEGIES)), ids=["doc_id"])


# Entries hold signs and wildcards, so a term is first met by the start of its first word and then tested as a pattern.
@_query(r"""
    WITH words AS (
        SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
    entries AS (
        SELECT page_id, generate_subscripts(list, 1) AS place, unnest(list) AS entry FROM (
            SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS list FROM pages)),
    terms AS (
        SELECT DISTINCT page_id, CASE WHEN place <= 3 THEN 'a' ELSE 'b' END AS category,
               trim(regexp_replace(replace(lower(entry), '"', ''), '\s+', ' ', 'g')) AS term
        FROM entries WHERE regexp_matches(entry, '[\p{L}\p{N}]') AND NOT regexp_matches(entry, '(?:^|[^\p{L}\p{N}*])\*')),
    starts AS (
        SELECT DISTINCT term, regexp_extract(term, '[\p{L}\p{N}]+') AS start, regexp_full_match(term, '[\p{L}\p{N}]+') AS plain,
               regexp_matches(term, '^[^\p{L}\p{N}]*[\p{L}\p{N}]+\*') AS open,
               replace(replace(regexp_replace(term, '([^\p{L}\p{N}\s*])', '\\\1', 'g'), ' ', '\s+'), '*', '[\p{L}\p{N}]*') AS pattern
        FROM terms),
    met AS (
        SELECT doc_id, term, plain, pattern FROM words JOIN starts ON word = start WHERE NOT open
        UNION SELECT doc_id, term, plain, pattern FROM words JOIN starts ON left(word, 1) = left(start, 1) AND starts_with(word, start)
        WHERE open),
    fits AS (
        SELECT doc_id, term FROM met WHERE plain
        UNION ALL SELECT doc_id, term FROM met JOIN documents USING (doc_id)
        WHERE NOT plain AND regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}])(?:' || pattern || ')(?:[^\p{L}\p{N}]|$)')),
    hits AS (SELECT doc_id, page_id, count(DISTINCT category) AS n FROM fits JOIN terms USING (term) GROUP BY ALL)
    SELECT doc_id, page_id AS search_id FROM hits
    JOIN (SELECT page_id, count(DISTINCT category) AS needed FROM terms GROUP BY page_id) USING (page_id)
    WHERE n = needed""")
def match_page_searches(spark, sf_dir):
    """One saved search per web page, out of its navigation list: words, phrases, signs and wildcards."""
    pages = _table(spark, sf_dir, "pages")
    entries = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    terms = (
        pages.select("page_id", F.posexplode(entries).alias("place", "term"))
        .where(F.col("term").rlike(_W) & ~F.col("term").rlike(rf"(?:^|[^\p{{L}}\p{{N}}*])\*"))
        .select(
            F.col("page_id").alias("search_id"),
            F.when(F.col("place") < 3, "a").otherwise("b").alias("category"),
            F.when(F.col("place") < 3, 0).otherwise(1).alias("category_pos"),
            F.lit(False).alias("is_exclusion"),
            F.col("place").alias("term_pos"),
            "term",
        )
    )
    types = terms.select("search_id", "category", F.lit("Title/Abstract").alias("search_type")).distinct()
    articles = runtime.spread_small(documents(spark, sf_dir).selectExpr("doc_id", "text AS abstract"), "doc_id")
    return search.match_searches(articles, terms, types, ids=["doc_id"])


_SYNTAX = [
    ("PubMed", "Title/Abstract", 0, "After", "[Title/Abstract]"),
    ("PubMed", "Title", 0, "After", "[Title]"),
    ("IEEE", "Title/Abstract", 0, "Before", '"Document Title": '),
    ("IEEE", "Title/Abstract", 1, "Before", '"Abstract": '),
    ("IEEE", "Title", 0, "Before", '"Document Title": '),
    ("ACM", "Title/Abstract", 0, "Before", "Title:( "),
    ("ACM", "Title/Abstract", 1, "Before", "Abstract:("),
    ("ACM", "Title/Abstract", 2, "After", ") "),
    ("ACM", "Title", 0, "Before", "Title:( "),
    ("ACM", "Title", 1, "After", ") "),
]
_PARTS = """
    ('PubMed', 'both', 0, '', '[Title/Abstract]'), ('PubMed', 'title', 0, '', '[Title]'),
    ('IEEE', 'both', 0, '"Document Title": ', ''), ('IEEE', 'both', 1, '"Abstract": ', ''),
    ('IEEE', 'title', 0, '"Document Title": ', ''),
    ('ACM', 'both', 0, 'Title:( ', ') '), ('ACM', 'both', 1, 'Abstract:(', ') '), ('ACM', 'title', 0, 'Title:( ', ') ')"""


_RENDERED = f"""
    WITH categories AS (
        SELECT conv_id, role, database,
               '(' || string_agg(before || text || after, ' OR ' ORDER BY part, turn) || ')' AS body
        FROM conversations
        JOIN (VALUES {_PARTS}) p(database, kind, part, before, after)
          ON kind = CASE role WHEN 'assistant' THEN 'title' ELSE 'both' END
        GROUP BY conv_id, role, database)
    SELECT conv_id AS search_id, database,
           regexp_replace(string_agg(CASE WHEN role = 'system' THEN ' NOT ' ELSE ' AND ' END || body, ''
                                     ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END),
                          '^ AND ', '') AS query
    FROM categories GROUP BY conv_id, database"""


@_query(_RENDERED)
def render_queries(spark, sf_dir):
    """One saved search per conversation: a category per role, and system turns as exclusion."""
    turns = _table(spark, sf_dir, "conversations")
    terms = turns.select(
        F.col("conv_id").alias("search_id"),
        F.when(F.col("role") == "system", schema.EXCLUSION_CATEGORY).otherwise(F.initcap("role")).alias("category"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("category_pos"),
        (F.col("role") == "system").alias("is_exclusion"),
        F.col("turn").cast("int").alias("term_pos"),
        F.col("text").alias("term"),
    )
    kind = F.when(F.col("category") == "Assistant", "title").otherwise("title/ABSTRACT")
    types = terms.select("search_id", F.lower("category").alias("category"), kind.alias("search_type"))
    return render.render_queries(terms, spark.createDataFrame(_SYNTAX, schema.SYNTAX), types)


# Landed files, derived from the documents

@_query("SELECT doc_id, text, CASE WHEN lang <> 'de' THEN lang END AS lang, source, n_chars FROM documents")
def csv_round_trip(spark, sf_dir):
    """Export with semicolons and read back: quotes, line breaks, missing values."""
    path = runtime.scratch_path(spark, "export") + ".csv"
    docs = documents(spark, sf_dir).withColumn("lang", F.expr("CASE WHEN lang <> 'de' THEN lang END"))
    sinks.export_csv(docs, path)
    back = delimited.read_table(spark, path, sep=";")
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "n_chars")})


@_query("SELECT doc_id, source, text FROM documents")
def tsv_round_trip(spark, sf_dir):
    path = runtime.scratch_path(spark, "export") + ".tsv"
    sinks.export_csv(documents(spark, sf_dir).select("doc_id", "source", "text"), path, "\t")
    return delimited.read_table(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


_YEAR_SQL = "CAST(year(DATE '1990-01-01' + CAST(n_chars % 10000 AS INT)) AS INT)"
_DOI_SQL = "'10.1000/' || source || '.' || doc_id"
_IEEE_SQL = f"""
    SELECT 'IEEE' AS source, 'A "study", of ' || source AS title, lang || ' One, ' || source || ' Two' AS authors,
           CAST(NULL AS VARCHAR) AS date, CASE WHEN lang <> 'es' THEN {_YEAR_SQL} END AS year, source AS journal_book,
           {_DOI_SQL} AS doi, CAST(NULL AS VARCHAR) AS pmid, 'https://example.org/' || doc_id AS url,
           replace(text, '; ', ', ') AS abstract, 'a, ' || lang AS keywords, CAST(n_chars AS VARCHAR) AS citation
    FROM documents"""


@_query(_IEEE_SQL)
def ieee_exports(spark, sf_dir):
    path = landed.ieee_exports(documents(spark, sf_dir))
    return harmonise.conform(delimited.read_ieee(spark, path)).select(*schema.ARTICLE_COLUMNS)


_PUBMED_SQL = f"""
    SELECT 'PubMed' AS source,
           CASE WHEN lang = 'es' THEN 'Chapter ' || doc_id ELSE 'On ' || lang || ' 2 where p <0.05 and n>3' END AS title,
           CASE lang WHEN 'es' THEN 'Ed ' || source WHEN 'fr' THEN '' ELSE lang || ' ' || source END AS authors,
           CASE WHEN lang = 'en' THEN 'Mar ' || {_YEAR_SQL} END AS date,
           {_YEAR_SQL} AS year,
           CASE WHEN lang <> 'es' THEN 'J & ' || source END AS journal_book,
           CASE WHEN lang = 'es' OR source <> 'src3' THEN {_DOI_SQL} END AS doi,
           CAST(doc_id AS VARCHAR) AS pmid,
           CASE WHEN lang <> 'es' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' END AS url,
           CASE WHEN lang = 'es' THEN '' ELSE 'Aim/Objective: From ' || source || '. ' END || text AS abstract,
           CASE WHEN lang IN ('en', 'fr') THEN 'k ' || lang || ', ' || source END AS keywords,
           CAST(NULL AS VARCHAR) AS citation
    FROM documents"""


@_query(f"SELECT *, CASE WHEN pmid IS NOT NULL AND url IS NOT NULL THEN 'Journal Article' END AS publication_type FROM ({_PUBMED_SQL})")
def pubmed_records(spark, sf_dir):
    path = landed.pubmed_files(documents(spark, sf_dir))
    records = pubmed.read_pubmed(spark, path)
    return harmonise.conform(records, keep_extra=True).select(*schema.ARTICLE_COLUMNS, "publication_type")


@_query(_PUBMED_SQL)
def pubmed_stream(spark, sf_dir):
    """The same records through the incremental ingest."""
    path, table = landed.pubmed_files(documents(spark, sf_dir)), runtime.scratch_path(spark, "table")
    ingest_pubmed(spark, path, table, runtime.scratch_path(spark, "progress"), "r1").awaitTermination()
    return sinks.read_runs(spark, table).select(*schema.ARTICLE_COLUMNS)


_ACM_SQL = f"""
    SELECT 'ACM' AS source, 'The ' || lang || ' – ' || source AS title,
           'Ann' || lang || ', Bo & ' || source AS authors,
           CASE WHEN lang <> 'de' THEN 'Jun ' || {_YEAR_SQL} END AS date, {_YEAR_SQL} AS year,
           CASE WHEN lang = 'en' THEN 'Proc. ' || source END AS journal_book, {_DOI_SQL} AS doi,
           CAST(NULL AS VARCHAR) AS pmid, 'https://dl.acm.org/doi/' || doc_id AS url,
           CASE WHEN lang <> 'fr' THEN text END AS abstract, CAST(NULL AS VARCHAR) AS keywords,
           CAST(n_chars AS VARCHAR) AS citation
    FROM documents"""


@_query(_ACM_SQL)
def acm_listing(spark, sf_dir):
    items = listing_source.read_listing(*landed.listing_pages(documents(spark, sf_dir)))
    return harmonise.conform(items).select(*schema.ARTICLE_COLUMNS)


@_query(f"""
    SELECT 'On ' || lang || ' and ' || source AS title, 'Ann' || lang || ', Bo' AS authors, 'Jun ' || {_YEAR_SQL} AS date,
           'Proc. ' || source || ' vol 1' AS journal_book, 'https://dl.acm.org/doi/' || doc_id AS url,
           CASE WHEN lang <> 'de' THEN CAST(n_chars AS VARCHAR) END AS citation
    FROM documents""")
def nested_elements(spark, sf_dir):
    """Items whose elements hold others of the same name, each taken up to its own closing tag."""
    items = listing_source.read_items(landed.nested_pages(documents(spark, sf_dir)))
    return items.select("title", "authors", "date", "journal_book", "url", "citation")


@_query("SELECT doc_id // 20 AS page_id, CAST(1000 + count(*) AS BIGINT) AS hits FROM documents GROUP BY ALL")
def reported_hits(spark, sf_dir):
    return listing_source.reported_hits(landed.listing_pages(documents(spark, sf_dir))[0])


@_query("""
    WITH turns AS (
        SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS place,
               CASE role WHEN 'system' THEN 'exclusion_category' ELSE role END AS category
        FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS search_id, category,
           CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INT) AS category_pos,
           category = 'exclusion_category' AS is_exclusion,
           CAST(row_number() OVER (PARTITION BY conv_id, place ORDER BY turn) - 1 AS INT) AS term_pos, text AS term
    FROM turns""")
def strategy_terms(spark, sf_dir):
    """Strategy files, one per conversation, read back as terms."""
    return strategy.read_terms(spark, landed.strategy_files(_table(spark, sf_dir, "conversations")))


@_query(f"""
    SELECT CAST(conv_id AS VARCHAR) AS search_id, database, search_type, CAST(syntax_pos AS INT) AS syntax_pos, position, text
    FROM (SELECT DISTINCT conv_id FROM conversations)
    CROSS JOIN (VALUES {", ".join(map(str, _SYNTAX))}) p(database, search_type, syntax_pos, position, text)""")
def strategy_syntax(spark, sf_dir):
    """Syntax files that hold for one search each, read back."""
    return strategy.read_syntax(spark, landed.syntax_files(_table(spark, sf_dir, "conversations"), _SYNTAX))


@_query("""
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS search_id,
           CASE role WHEN 'system' THEN 'exclusion_category' ELSE role END AS category,
           CASE role WHEN 'assistant' THEN 'title' ELSE 'Title/Abstract' END AS search_type
    FROM conversations""")
def strategy_types(spark, sf_dir):
    """Search types out of settings files with a section per search, other sections left aside."""
    return strategy.read_search_types(spark, landed.settings_files(_table(spark, sf_dir, "conversations")))


@_query(_RENDERED.replace("conv_id AS search_id", "CAST(conv_id AS VARCHAR) AS search_id"))
def render_from_files(spark, sf_dir):
    """Search texts out of three kinds of files: strategies, syntax and settings."""
    turns = _table(spark, sf_dir, "conversations")
    terms = strategy.read_terms(spark, landed.strategy_files(turns))
    syntax = strategy.read_syntax(spark, landed.syntax_files(turns, _SYNTAX))
    return render.render_queries(terms, syntax, strategy.read_search_types(spark, landed.settings_files(turns)))


@_query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang <> 'de' THEN source END AS source, text FROM documents")
def mixed_folder(spark, sf_dir):
    """Comma, tab and Parquet files of one folder as one table."""
    return delimited.read_folder(spark, landed.mixed_folder(documents(spark, sf_dir)))


@_query("""
    SELECT strftime((SELECT max(ts) FROM events), '%Y-%m-%d_%H%M%S') || '_complete_articles' AS run_id,
           row_number() OVER (ORDER BY source, doc_id) - 1 AS article_id, source, text AS title, lang AS keywords
    FROM documents""")
def export_run(spark, sf_dir):
    """A numbered run exported under the time stamp of the last event, then found by its name and read."""
    stamp = _table(spark, sf_dir, "events").agg(text.run_stamp(F.max("ts"))).first()[0]
    folder = runtime.scratch_path(spark, "exports")
    run = documents(spark, sf_dir).selectExpr("source", "doc_id", "text AS title", "lang AS keywords")
    sinks.export_run(harmonise.assign_ids(run, ["source", "doc_id"]).drop("doc_id"), folder, stamp)
    return delimited.read_exports(spark, folder)


@_query("""
    SELECT doc_id, lang = 'de' OR lang = 'fr' AS failed,
           CASE lang WHEN 'de' THEN 'backend ' || source WHEN 'fr' THEN 'No ''Details'' found.' END AS details
    FROM documents""")
def quarantine(spark, sf_dir):
    good, failed = pubmed.split_errors(landed.answers(documents(spark, sf_dir)))
    none = F.lit(None).cast("string")
    return good.select("doc_id", F.lit(False).alias("failed"), none.alias("details")).unionByName(
        failed.select("doc_id", F.lit(True).alias("failed"), "details")
    )


@_query("""
    SELECT doc_id AS article_id, CASE WHEN lang IN ('de', 'fr') THEN 'later' ELSE 'first' END AS title, lang AS run_id, source
    FROM documents""")
def write_run(spark, sf_dir):
    """Four runs written, two of them written again; the others must stay."""
    path = runtime.scratch_path(spark, "runs")
    runs = documents(spark, sf_dir).selectExpr("doc_id AS article_id", "'first' AS title", "lang AS run_id", "source")
    sinks.write_run(runs, path)
    sinks.write_run(runs.where("run_id IN ('de', 'fr')").withColumn("title", F.lit("later")), path)
    return sinks.read_runs(spark, path)


@_query("""
    SELECT doc_id AS article_id, lang AS run_id,
           CASE WHEN row_number() OVER (
               PARTITION BY lang ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) <= 10 THEN 'x' END AS pilot,
           CASE WHEN count(*) OVER (PARTITION BY lang, text) > 1 THEN 'x' ELSE '' END AS duplicate
    FROM documents""")
def screen_runs_table(spark, sf_dir):
    """All runs of a table marked, written to a table of their own and read back."""
    path = runtime.scratch_path(spark, "screened")
    runs = documents(spark, sf_dir).selectExpr("doc_id AS article_id", "text AS doi", "lang AS run_id", "source")
    marked = screen_runs(runs, schema.Params(screening="Pilot", nr_randomizations=10))
    sinks.write_screened(marked, path)
    return sinks.read_runs(spark, path).select("article_id", "run_id", "pilot", "duplicate")


@_query(f"""
    WITH capped AS (
        SELECT * FROM (SELECT *, doc_id // 20 AS page FROM documents)
        QUALIFY row_number() OVER (ORDER BY lpad(CAST(page AS VARCHAR), 20, '0'), doc_id) <= 150),
    acm AS ({_ACM_SQL.replace("FROM documents", "FROM capped")}),
    kept AS (SELECT * FROM ({_IEEE_SQL} UNION ALL SELECT * FROM acm) WHERE year IS NULL OR year >= 1994),
    numbers AS (SELECT *, source = 'IEEE' AS first FROM kept)
    SELECT * EXCLUDE (first), CASE WHEN first THEN 'low' ELSE 'high' END AS side FROM numbers""")
def complete_run(spark, sf_dir):
    """A whole run: IEEE exports and ACM pages, the latter capped, then years filtered and rows numbered."""
    docs = documents(spark, sf_dir)
    sources = [
        delimited.read_ieee(spark, landed.ieee_exports(docs)),
        listing_source.read_listing(*landed.listing_pages(docs)),
    ]
    run = build_run(sources, schema.Params(start_year=1994, max_results=150), "2024-01-02_030405")
    # File names are made up by the writer, so numbers are checked by what they promise: IEEE first, none left out.
    ieee = F.count_if(F.col("source") == "IEEE")
    ends = run.agg(ieee.alias("low"), F.count("*").alias("n"), F.count_distinct("article_id").alias("ids"),
                   F.max("article_id").alias("last")).first()
    if (ends["ids"], (ends["last"] or 0) + 1) != (ends["n"], ends["n"]):
        raise ValueError("article numbers have gaps")
    side = F.when(F.col("article_id") < ends["low"], "low").otherwise("high")
    return run.select(*schema.ARTICLE_COLUMNS, side.alias("side"))


# Faulty files, streams and batches, and many strategies

@_query("""
    SELECT doc_id, CASE WHEN lang <> 'de' THEN source END AS source, lang = 'de' AS failed FROM documents""")
def csv_malformed(spark, sf_dir):
    """Rows with a field too many are set apart; the others are read."""
    docs = documents(spark, sf_dir)
    line = F.concat_ws(";", "doc_id", "source", F.when(F.col("lang") == "de", "more"))
    path = landed.in_files(docs.select("doc_id", line.alias("value")), "doc_id", "doc_id;source", None, landed.file_count(docs, 1_000_000))
    good, bad = delimited.split_malformed(spark, path, ";")
    number = F.substring_index("details", ";", 1).cast("bigint").alias("doc_id")
    return good.select(F.col("doc_id").cast("bigint"), "source", F.lit(False).alias("failed")).unionByName(
        bad.select(number, F.lit(None).cast("string").alias("source"), F.lit(True).alias("failed")))


@_query(f"""
    SELECT source, title, pmid, abstract, 0 AS bad_files, 0 AS bad_records FROM ({_PUBMED_SQL})
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, CAST(count(DISTINCT doc_id // 200) AS INT), CAST(count(DISTINCT doc_id // 200) AS INT)
    FROM documents WHERE (doc_id // 200) % 3 = 1""")
def pubmed_malformed(spark, sf_dir):
    """Records that are cut off are set apart; all others of their files are read."""
    good, bad = pubmed.split_malformed(spark, landed.pubmed_files(documents(spark, sf_dir), broken=True))
    kept = ["source", "title", "pmid", "abstract"]
    count = bad.agg(F.countDistinct("file").cast("int").alias("bad_files"), F.count("*").cast("int").alias("bad_records"))
    none = F.lit(0)
    return good.select(*kept, none.alias("bad_files"), none.alias("bad_records")).unionByName(count, allowMissingColumns=True)


@_query(f"""
    SELECT 'r1' AS run_id, title, pmid FROM ({_PUBMED_SQL})
    UNION ALL SELECT 'r2', text, CAST(doc_id AS VARCHAR) FROM documents""")
def stream_then_batch(spark, sf_dir):
    """One table for a streamed run, one of whose batches is repeated, and for a run written at once."""
    docs, table = documents(spark, sf_dir), runtime.scratch_path(spark, "table")
    path = landed.pubmed_files(docs)
    ingest_pubmed(spark, path, table, runtime.scratch_path(spark, "progress"), "r1").awaitTermination()
    again = harmonise.conform(pubmed.read_pubmed(spark, path), keep_extra=True).withColumn("run_id", F.lit("r1"))
    sinks.write_batch(again.drop("ingest_seq", "publication_type"), table, 0)
    run = docs.selectExpr("'r2' AS run_id", "text AS title", "CAST(doc_id AS STRING) AS pmid")
    sinks.write_run(harmonise.conform(run), table)
    return sinks.read_runs(spark, table).select("run_id", "title", "pmid")


@_query(f"SELECT 'r1' AS run_id, title, abstract, pmid FROM ({_PUBMED_SQL})")
def stream_new_checkpoint(spark, sf_dir):
    """The same folder ingested under a second checkpoint: each landed file is taken once."""
    path, table = landed.pubmed_files(documents(spark, sf_dir)), runtime.scratch_path(spark, "table")
    for files in (1000, 7):
        progress = runtime.scratch_path(spark, "progress")
        ingest_pubmed(spark, path, table, progress, "r1", files_per_batch=files).awaitTermination()
    return sinks.read_runs(spark, table).select("run_id", "title", "abstract", "pmid")


@_query("""
    SELECT doc_id, text AS title, 'r1' AS run_id, source AS publication_type, CAST(NULL AS VARCHAR) AS ieee_extra FROM documents
    WHERE lang = 'en'
    UNION ALL SELECT doc_id, text, 'r2', NULL, lang FROM documents WHERE lang <> 'en'""")
def runs_of_two_shapes(spark, sf_dir):
    """Runs with columns of their own in one table; those that a run lacks are null."""
    docs, table = documents(spark, sf_dir).withColumnRenamed("text", "title"), runtime.scratch_path(spark, "table")
    one = docs.where("lang = 'en'").selectExpr("doc_id", "title", "'r1' AS run_id", "source AS publication_type")
    two = docs.where("lang <> 'en'").selectExpr("doc_id", "title", "'r2' AS run_id", "lang AS ieee_extra")
    for run in (one.withColumn("title", F.lit("replaced")), two, one):
        sinks.write_run(run, table)
    return sinks.read_runs(spark, table)


@_query("""
    SELECT doc_id, lang AS run_id, lang IN ('en', 'fr') AS refused FROM documents""")
def stream_into_batch_run(spark, sf_dir):
    """A run written at once takes no batches, and its rows stay as they were; other runs take theirs."""
    docs, table = documents(spark, sf_dir).selectExpr("doc_id", "lang AS run_id"), runtime.scratch_path(spark, "table")
    at_once = docs.where("lang IN ('en', 'fr')")
    sinks.write_run(at_once, table)
    try:
        sinks.write_batch(docs, table, 0)
    except ValueError:
        sinks.write_batch(docs.where("run_id NOT IN ('en', 'fr')"), table, 0)
    return sinks.read_runs(spark, table).select("doc_id", "run_id", F.col("run_id").isin("en", "fr").alias("refused"))


@_query("""
    WITH ids AS (
        SELECT doc_id // 1000 AS search, doc_id % 1000 // 50 AS number, doc_id,
               50 * (doc_id % 1000 // 50) + row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS place
        FROM documents),
    landed AS (SELECT * FROM ids WHERE number % 7 <> 3),
    pages AS (
        SELECT search, number, min(50 * number) AS low, max(place) + 1 AS high, 1000 + CASE WHEN number % 11 = 10 THEN 1 ELSE 0 END AS total
        FROM landed GROUP BY search, number),
    opened AS (
        SELECT *, greatest(low - coalesce(max(high) OVER (
            PARTITION BY search ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM pages),
    covered AS (
        SELECT search, max(total) AS total, min(total) = max(total) AS totals_agree,
               sum(gap) + greatest(max(total) - max(high), 0) AS missing,
               count(*) FILTER (gap > 0) + CASE WHEN max(total) > max(high) THEN 1 ELSE 0 END AS gaps
        FROM opened GROUP BY search),
    counted AS (SELECT search, count(*) AS found, count(*) FILTER (number % 5 = 1) AS repeated FROM landed GROUP BY search)
    SELECT 'S' || search || '/1' AS search, place, CAST(doc_id AS VARCHAR) AS pmid, CAST(total AS BIGINT) AS total, totals_agree, found,
           CAST(missing AS BIGINT) AS missing, CAST(gaps AS BIGINT) AS gaps, repeated, CAST(0 AS BIGINT) AS conflicts
    FROM landed JOIN covered USING (search) JOIN counted USING (search)""")
def paged_answers(spark, sf_dir):
    """Answers in pages, shuffled, repeated and missing, put together; each id with the report on its search."""
    pages = pubmed.read_search_pages(spark, landed.search_pages(documents(spark, sf_dir)))
    ids, report = assemble_pages(pages)
    return ids.join(report, "search")


_RUN_IDS = "CASE lang WHEN 'de' THEN '007' WHEN 'fr' THEN '2024-01-02' WHEN 'es' THEN '1e3' ELSE 'r' END"


@_query(f"SELECT doc_id AS article_id, text AS title, {_RUN_IDS} AS run_id FROM documents")
def write_run_text_ids(spark, sf_dir):
    """Run ids that look like numbers and dates come back as they were written."""
    path = runtime.scratch_path(spark, "runs")
    sinks.write_run(documents(spark, sf_dir).selectExpr("doc_id AS article_id", "text AS title", f"{_RUN_IDS} AS run_id"), path)
    return sinks.read_runs(spark, path)


@_query(f"""
    SELECT number AS article_id, number AS source_article_id, source, title, notes, quality
    FROM (SELECT *, row_number() OVER (ORDER BY side, article_id) - 1 AS number FROM ({_compared()}))""")
def compare_again(spark, sf_dir):
    """A numbered comparison is compared with the same new run: nothing is left to add."""
    old, new = _runs(spark, sf_dir)
    first = sinks.number_comparison(compare.compare_runs(old, new, with_side=True))
    return sinks.number_comparison(compare.compare_runs(first, new, with_side=True))


@_query("""
    SELECT doc_id AS article_id, 'run=' || doc_id // 200 AS run_id, CAST(2000 + n_chars % 20 AS INT) AS year,
           CASE WHEN count(*) OVER (PARTITION BY doc_id // 200, text) > 1 THEN 'x' ELSE '' END AS duplicate
    FROM documents""")
def screen_exports(spark, sf_dir):
    """A folder of exports of four shapes as runs named after them, with years as tables with gaps write them."""
    folder = landed.export_folder(documents(spark, sf_dir))
    marked = screen_runs(delimited.read_exports(spark, folder), schema.Params())
    return marked.select("article_id", "run_id", "year", "duplicate")


@_query("""
    SELECT count(*) OVER (PARTITION BY source, doc_id // 500) AS total,
           CAST(row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY doc_id) - 1 AS INT) AS position,
           CAST(doc_id AS VARCHAR) AS pmid
    FROM documents""")
def search_answers(spark, sf_dir):
    """Totals and ids out of landed answers to searches."""
    return pubmed.read_search_answers(spark, landed.search_answers(documents(spark, sf_dir))).drop("file")


@_query("SELECT CAST(doc_id AS VARCHAR) AS pmid, source, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def records_of_search(spark, sf_dir):
    """The records whose ids a search has returned."""
    docs = documents(spark, sf_dir)
    found = docs.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    ids = pubmed.read_search_answers(spark, landed.search_answers(found))
    return compare.restrict_to_ids(docs.select(F.col("doc_id").cast("string").alias("pmid"), "source", "text"), ids)


_LONG_WORDS = r"""
    WITH words AS (
        SELECT DISTINCT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents)""".replace("\\\\", "\\")


@_query(_LONG_WORDS + """
    SELECT doc_id FROM words GROUP BY doc_id
    HAVING bool_or(length(word) >= 8) AND NOT bool_or(word IN (SELECT word FROM words WHERE lang = 'fr' AND length(word) >= 16))""")
def boolean_search_many_terms(spark, sf_dir):
    """One strategy out of the long words of all documents, more than fit into one expression."""
    docs = runtime.spread_small(documents(spark, sf_dir), "doc_id")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"{_W}+"), F.lit(0)))
    words = docs.select("lang", F.explode(F.filter(found, lambda w: F.length(w) >= 8)).alias("term"))
    # Texts are cut into words once, for both categories.
    left_out = (F.col("lang") == "fr") & (F.length("term") >= 16)
    categories = F.filter(F.array(F.lit("long"), F.when(left_out, schema.EXCLUSION_CATEGORY)), lambda c: c.isNotNull())
    terms = words.select("term", F.explode(categories).alias("category")).distinct().select(
        F.lit("s").alias("search_id"), "category", F.lit(0).alias("category_pos"),
        (F.col("category") == schema.EXCLUSION_CATEGORY).alias("is_exclusion"), F.lit(0).alias("term_pos"), "term")
    types = spark.createDataFrame(
        [("s", c, "title/abstract") for c in ("long", schema.EXCLUSION_CATEGORY)], schema.SEARCH_TYPES)
    return search.boolean_search(docs.selectExpr("doc_id", "text AS abstract"), terms, types).select("doc_id")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: documents as one run of articles, filtered, numbered, then screened."""
    docs = documents(spark, "/root/testdata/sf0.001")
    articles = harmonise.conform(docs.select(
        F.lit("r1").alias("run_id"), "source", F.col("text").alias("title"), F.col("text").alias("doi"),
        landed.year().alias("year"), F.col("lang").alias("keywords"), F.col("doc_id").alias("document"),
    ), keep_extra=True)
    kept = harmonise.year_between(articles, 1992, None)
    numbered = harmonise.assign_ids(kept, ["source", "document"])
    return screen_runs(numbered, schema.Params(screening="Pilot"))


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this module alone."""
    return dict(_QUERIES)


def _text_training():
    """The queries of the text-training package, where it is installed."""
    try:
        import corpus_pipeline
        from bibflow.llm.queries import QUERIES, SQL
    except ImportError:  # the package, or a library that it needs, is not there
        return {}, {}

    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**SQL, **sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_text_training()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **_text_training()[1]}
