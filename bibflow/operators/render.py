"""Search text of many saved searches in the syntax of several databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.plans.skew import Limits


def _joined(pieces: Column, by: list[str], separator: str) -> Column:
    """The ``text`` of collected structs, in the order of their leading fields."""
    packed = F.array_sort(F.collect_list(F.struct(*by, pieces.alias("text"))))
    return F.array_join(F.transform(packed, lambda p: p["text"]), separator)


def _fail_on(missing: DataFrame, text: str) -> None:
    row = missing.first()
    if row is not None:
        raise ValueError(f"{text}: {', '.join(str(v) for v in row)}")


def render_queries(
    terms: DataFrame,
    syntax: DataFrame,
    search_types: DataFrame,
    databases: list[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """``query`` for every search and database.

    Terms of a category are joined by OR, once for each part of the database's
    syntax; categories by AND in their order; an exclusion follows NOT.
    Databases, categories and search types are matched without regard to case.
    A category without a search type raises. A syntax with a ``search_id`` column
    holds for that search alone.
    """
    own = [c for c in ["search_id"] if c in syntax.columns]
    parts = syntax.withColumn("type_key", F.lower("search_type"))
    names = [r[0] for r in parts.select("database").distinct().orderBy("database").collect()]
    if databases is not None:
        unknown = {d.lower() for d in databases} - {n.lower() for n in names}
        if unknown:
            raise ValueError(f"database not found: {', '.join(sorted(unknown))}")
        names = [n for n in names if n.lower() in {d.lower() for d in databases}]
        parts = parts.where(F.col("database").isin(names))

    # One row per leading part: (before, after) around a term. Syntaxes with a
    # mix of parts that has no text form keep one row without any text.
    before, after = F.col("position") == "Before", F.col("position") == "After"
    shapes = parts.groupBy(*own, "database", "type_key").agg(
        F.count_if(before).alias("n_before"),
        F.count_if(after).alias("n_after"),
        F.max(F.when(after, F.col("text"))).alias("closing"),
    )
    shaped = parts.join(shapes, [*own, "database", "type_key"])
    only_before = (F.col("n_before") > 0) & (F.col("n_after") == 0)
    only_after = (F.col("n_before") == 0) & (F.col("n_after") > 0)
    around = (F.col("n_before") > 0) & (F.col("n_after") == 1)
    leads = (before & (only_before | around)) | (after & only_after)
    has_text = only_before | only_after | around
    decorated = shaped.where(leads | ~has_text).select(
        *own,
        "database",
        "type_key",
        "syntax_pos",
        has_text.alias("has_text"),
        F.when(before, F.col("text")).otherwise("").alias("before"),
        F.when(after, F.col("text")).when(around, F.col("closing")).otherwise("").alias("after"),
    )

    types = search_types.select(
        "search_id", F.lower("category").alias("category_key"), F.lower("search_type").alias("type_key")
    ).distinct()
    if own:
        asked = types.select(*own, "type_key").distinct().join(parts.select(*own, "database").distinct(), own)
    else:
        asked = types.select("type_key").distinct().select(
            "type_key", F.explode(F.array(*map(F.lit, names))).alias("database")
        )
    _fail_on(
        asked.join(shapes, [*own, "database", "type_key"], "left_anti").select("type_key", "database"),
        "search type not found for database",
    )
    if decorated.count() <= limits.broadcast_keys:
        decorated = F.broadcast(decorated)
    keyed = terms.withColumn("category_key", F.lower("category"))
    _fail_on(
        keyed.join(types, ["search_id", "category_key"], "left_anti").select("search_id", "category"),
        "category without a search type",
    )
    typed = keyed.join(types, ["search_id", "category_key"])

    # All terms of a search meet in one task, since its text is one value.
    categories = (
        typed.join(decorated, [*own, "type_key"])
        .repartition("search_id", "database")
        .groupBy("search_id", "database", "category_pos", "is_exclusion")
        .agg(
            F.bool_or("has_text").alias("has_text"),
            _joined(
                F.concat("before", "term", "after"), ["syntax_pos", "term_pos"], " OR "
            ).alias("body"),
        )
    )
    text = F.concat(F.lit("("), F.when(F.col("has_text"), F.col("body")).otherwise(""), F.lit(")"))
    linked = F.concat(F.when(F.col("is_exclusion"), " NOT ").otherwise(" AND "), text)
    query = categories.groupBy("search_id", "database").agg(_joined(linked, ["category_pos"], "").alias("query"))
    # The first category has no AND before it; an exclusion always has its NOT.
    return query.withColumn("query", F.regexp_replace("query", "^ AND ", ""))
