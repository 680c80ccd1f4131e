"""Command line: ``spark-submit`` or ``python -m bibflow <step> ...``.

build     landed files to one numbered run in the article table
screen    pilot and duplicate marks for every run of a table or of a folder of exports
compare   two runs of a table, or two exported files, by title
render    the search text of a strategy for one or all databases
search    the articles of a table that fit a strategy, or which of many strategies each fits
"""

from __future__ import annotations

import argparse
from pyspark.sql import functions as F

from bibflow import sinks
from bibflow.functions.text import run_stamp
from bibflow.operators.compare import compare_runs
from bibflow.operators.render import render_queries
from bibflow.operators.search import boolean_search, match_searches
from bibflow.plans.runs import build_run, compare_run_ids, screen_runs
from bibflow.runtime import drop_scratch, session
from bibflow.schema import Params
from bibflow.sources.delimited import read_exports, read_ieee, read_table
from bibflow.sources.listing import read_listing
from bibflow.sources.pubmed import read_pubmed, split_malformed
from bibflow.sources.strategy import read_search_types, read_syntax, read_terms


def build(spark, args, params, stamp):
    sources = []
    if args.ieee:
        sources.append(read_ieee(spark, args.ieee))
    if args.pubmed:
        if args.rejected:
            records, faults = split_malformed(spark, args.pubmed)
            sinks.write_rejected(faults, args.rejected, stamp)
            sources.append(records)
        else:  # a fault stops the run and names its file; --rejected goes on without
            sources.append(read_pubmed(spark, args.pubmed))
    if bool(args.acm_pages) != bool(args.acm_details):
        raise SystemExit("--acm-pages and --acm-details go together")
    if args.acm_pages:
        sources.append(read_listing(spark.read.parquet(args.acm_pages), spark.read.parquet(args.acm_details)))
    if not sources:
        raise SystemExit("give at least one of --ieee, --pubmed, --acm-pages")
    sinks.write_run(build_run(sources, params, stamp), args.table)
    if args.export:
        run = sinks.read_runs(spark, args.table).where(f"run_id = '{stamp}'").drop("run_id")
        print(sinks.export_run(run, args.export, stamp))


def screen(spark, args, params, stamp):
    runs = read_exports(spark, args.exports) if args.exports else sinks.read_runs(spark, args.table)
    sinks.write_screened(screen_runs(runs, params), args.out)


def compare(spark, args, params, stamp):
    if args.table:
        compared = compare_run_ids(sinks.read_runs(spark, args.table), args.old, args.new)
    else:
        old, new = (read_table(spark, path, "csv", ";") for path in (args.old, args.new))
        old, new = map(numbered, (old, new))
        notes = next((c for c in old.columns if c.lower() == "notes"), "notes")
        compared = compare_runs(old, new, notes=notes, with_side=True)
    print(sinks.export_comparison(compared, args.out, stamp))


def numbered(df):
    """The numbers of a file as numbers, or those of its rows where it has none."""
    number = df["article_id"].cast("bigint") if "article_id" in df.columns else F.monotonically_increasing_id()
    return df.withColumn("article_id", number)


def _strategies(spark, args):
    """All strategies of a file or folder; the settings hold for each."""
    terms = read_terms(spark, args.strategy)
    return terms, read_search_types(spark, args.params, terms)


def render(spark, args, params, stamp):
    terms, types = _strategies(spark, args)
    database = args.database or params.database
    queries = render_queries(terms, read_syntax(spark, args.strategy), types, [database] if database else None)
    many = terms.select("search_id").distinct().limit(2).count() > 1
    for row in queries.orderBy("search_id", "database").toLocalIterator():
        print(f"{row['search_id']}, " * many + f"{row['database']}: {row['query']}")


def search(spark, args, params, stamp):
    articles, (terms, types) = sinks.read_runs(spark, args.table), _strategies(spark, args)
    if terms.select("search_id").distinct().limit(2).count() == 1:
        boolean_search(articles, terms, types).write.parquet(args.out)
    else:
        match_searches(articles, terms, types, ids=["run_id", "article_id"]).write.parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="bibflow", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    steps = parser.add_subparsers(dest="step", required=True)
    options = {
        build: {"ieee": False, "pubmed": False, "acm-pages": False, "acm-details": False, "table": True, "export": False, "rejected": False},
        screen: {"table": False, "exports": False, "out": True},
        compare: {"table": False, "old": True, "new": False, "out": True},
        render: {"strategy": True, "database": False},
        search: {"table": True, "strategy": True, "out": True},
    }
    for step, names in options.items():
        sub = steps.add_parser(step.__name__)
        sub.set_defaults(run=step)
        sub.add_argument("--input-gb", type=int, help="size of the input, to cut shuffles accordingly")
        sub.add_argument("--params", required=step in (render, search), help="INI file with years, cap, sample and search types")
        for name, required in names.items():
            sub.add_argument(f"--{name}", required=required)
    args = parser.parse_args(argv)
    spark = session("bibflow", args.input_gb << 30 if args.input_gb else None)
    params = Params.from_ini(args.params) if args.params else Params()
    try:
        args.run(spark, args, params, spark.range(1).select(run_stamp(F.current_timestamp())).first()[0])
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
