"""Whole runs: build one, screen runs, compare two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.operators.compare import compare_runs, select_run
from bibflow.operators.harmonise import (
    assign_ids, cap_per_source, conform, source_rank, union_sources, year_between,
)
from bibflow.operators.screen import mark_duplicates, pilot_sample
from bibflow.plans.skew import Limits
from bibflow.runtime import materialise
from bibflow.schema import INGEST_ORDER, Params

# Fixed value: the one source that a run takes whole.
UNCAPPED = "IEEE"


def build_run(sources: list[DataFrame], params: Params, run_id: str, limits: Limits = Limits()) -> DataFrame:
    """One numbered article table out of records as the readers return them.

    The order of steps counts: each source is capped by arrival, then years
    are filtered, then the rest is numbered by source and arrival. Parsing
    happens once; later passes read the written records.
    """
    frames = [conform(_with_arrival(s), keep_extra=True) for s in sources]
    parsed = materialise(union_sources(*frames), "records")
    records = conform(parsed.withColumn("run_id", F.lit(run_id)), keep_extra=True)
    exempt = F.col("source") == UNCAPPED
    if params.max_results is not None:
        capped = cap_per_source(
            records.where(~exempt), params.max_results, ["run_id", "source"], INGEST_ORDER, limits
        )
        records = records.where(exempt).unionByName(capped)
    kept = year_between(records, params.start_year, params.end_year)
    return assign_ids(kept, [source_rank(), "source", *INGEST_ORDER]).drop(*INGEST_ORDER, "ingest_path")


def _with_arrival(records: DataFrame) -> DataFrame:
    """Fill in what a source does not say about arrival: its rows then follow in the order they are read."""
    defaults = {
        "ingest_file": F.lit(""), "record_kind": F.lit(0), "ingest_seq": F.monotonically_increasing_id(),
    }
    return records.withColumns({c: v for c, v in defaults.items() if c not in records.columns})


def screen_runs(articles: DataFrame, params: Params, limits: Limits = Limits()) -> DataFrame:
    """Pilot and duplicate marks for every run in the table. The pilot ignores duplicates."""
    if params.screening is not None:
        articles = pilot_sample(articles, params.nr_randomizations, params.seed, limits=limits)
    return mark_duplicates(articles, limits=limits)


def compare_run_ids(articles: DataFrame, old_run: str, new_run: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Compare two runs of the table; without ``new_run`` the latest one."""
    old, new = select_run(articles, old_run), select_run(articles, new_run)
    return compare_runs(old, new, with_side=True, limits=limits)
