"""Delimited text files, among them IEEE exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibflow.functions.keys import key_of
from bibflow.functions.text import blank_to_null, in_natural_order, year_number
from bibflow.operators.harmonise import replace_separators, union_sources
from bibflow.plans.skew import KEY, Limits, member_join
from bibflow.runtime import materialise
from bibflow.schema import ARTICLE_COLUMNS, IEEE_DROPS, IEEE_RENAMES

_CORRUPT = "_corrupt_record"
_RUN_COLUMNS = ["run_id", "article_id", *ARTICLE_COLUMNS]

# Separators that a .csv file may have; a .tsv file has tabs.
CSV_SEPARATORS = [",", ";"]

# Columns that are read beyond those of the first header, before a folder is read again with all that may be.
_SPARE_COLUMNS = 8


def _reader(spark: SparkSession, sep: str):
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", True)
    )


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Files with one header, every column as text.

    A file is read by one task, since fields may hold line breaks. Blank
    fields are null; words such as ``NA`` stay text. Files whose headers
    differ raise instead of mixing up their columns. A row with fewer fields
    than the header ends in nulls; one with more stops the job, and so does a
    quote that is not closed where fields are missing behind it.
    """
    reader = _reader(spark, sep)
    names = reader.csv(path).columns
    df, faults = _with_faults(reader, path, names, sep)
    stop = F.raise_error(F.concat(F.lit("malformed record: "), F.left(F.col(_CORRUPT), F.lit(200))))
    df = df.where(F.when(faults, stop).isNull())
    return df.select(*[blank_to_null(F.col(f"`{n}`")).alias(n) for n in names])


def _with_faults(reader, path, names: list[str], sep: str) -> tuple[DataFrame, Column]:
    """The rows of files with these columns, and whether a row is malformed and not merely short."""
    fields = [T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]]
    df = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", _CORRUPT).option("enforceSchema", False).csv(path)
    raw = F.col(_CORRUPT)
    # Nothing of the first field is added; the reader refuses a query on the corrupt records alone.
    raw = F.concat(raw, F.coalesce(F.substring(F.col(f"`{names[0]}`"), 1, 0), F.lit("")))
    bare = F.regexp_replace(raw, '"(?:[^"]|"")*"', "")
    long = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= len(names)
    return df, F.coalesce(raw.isNotNull() & (long | bare.contains('"')), F.lit(False))


def split_malformed(spark: SparkSession, path: str | list[str], sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """The rows that ``read_delimited`` can read, and ``file`` and ``details`` of the others."""
    reader = _reader(spark, sep)
    names = reader.csv(path).columns
    df, faults = _with_faults(reader, path, names, sep)
    df = df.select("*", faults.alias("_fault"), F.col("_metadata.file_path").alias("_file"))
    good = df.where(~F.col("_fault")).select(*[blank_to_null(F.col(f"`{n}`")).alias(n) for n in names])
    bad = df.where("_fault").select(F.col("_file").alias("file"), F.col(_CORRUPT).alias("details"), F.col(f"`{names[0]}`").alias("first"))
    return good, materialise(bad, "malformed").drop("first")


def _raw_rows(reader, path: str, sep: str, columns: int) -> DataFrame:
    """Records as arrays of at most ``columns`` fields, with their width and faults.

    ``_full`` is set where a record may have so many fields or more, so that its width is not known well.
    """
    cells = [f"_c{i}" for i in range(columns)]
    fields = [T.StructField(n, T.StringType()) for n in [*cells, _CORRUPT]]
    read = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", _CORRUPT).csv(path)

    def signs(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))

    bare = F.regexp_replace(_CORRUPT, '"[^"]*"', "")
    # Quotes count at the start of a field only, as for the parser: never less separators than it found.
    outside = F.regexp_replace(_CORRUPT, f'(?<![^{re.escape(sep)}])"[^"]*+(?:""[^"]*+)*+"', "")
    filled = F.array_max(F.transform(F.col("_cells"), lambda v, i: F.when(v.isNotNull(), i + 1)))
    return (
        read.select("*", F.array(*cells).alias("_cells"), F.col("_metadata.file_path").alias("_file"))
        .select(
            "_file", F.monotonically_increasing_id().alias("_seq"), "_cells",
            F.coalesce(F.greatest(signs(bare) + 1, filled), F.lit(columns)).alias("_width"),
            F.coalesce(bare.rlike(f'(?:^|{re.escape(sep)})"'), F.lit(False)).alias("_open"),
            F.coalesce(bare.contains('"'), F.lit(False)).alias("_odd"), F.left(_CORRUPT, F.lit(200)).alias("_start"),
            F.coalesce(signs(outside) + 1 >= columns, F.lit(True)).alias("_full"),
        )
        .withColumn("_cells", F.slice("_cells", F.lit(1), F.least(F.col("_width"), F.lit(columns))))
    )


def _rows_by_header(
    spark: SparkSession, path: str, sep: str, glob: str, required: list[str], known: list[str], max_columns: int, limits: Limits
) -> tuple[DataFrame, list[str]]:
    """The records of all files of a folder, whatever columns each has, and the names of all columns.

    Files are read once, without a header and as arrays, and written. The first row of
    a file names its columns; ``_at`` says for each name where a record's file has
    it, -1 if nowhere. Names count without regard to case and are spelled as in ``known``; an
    empty one is ``_c`` and its place, one that a file has twice gets its place at the end.
    """
    reader = _reader(spark, sep).option("header", False).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    # The parser takes long over each column that a row lacks, so the first header found says how many are read.
    header = _raw_rows(reader, path, sep, max_columns).select("_width").first()
    columns = min(max_columns, (header["_width"] if header else 0) + _SPARE_COLUMNS)
    rows = materialise(_raw_rows(reader, path, sep, columns), "rows")
    if columns < max_columns and not rows.where("_full").select("_full").isEmpty():
        rows = materialise(_raw_rows(reader, path, sep, max_columns), "rows")
    rows = rows.drop("_full")
    first = materialise(rows.groupBy("_file").agg(F.min("_seq").alias(KEY)), "first").select(KEY)
    heads = member_join(rows.withColumn(KEY, F.col("_seq")), first, "left_semi", limits=limits)
    named = F.transform("_cells", lambda v, i: F.coalesce(
        F.nullif(F.regexp_replace(v, "^\ufeff", ""), F.lit("")), F.concat(F.lit("_c"), i.cast("string"))))
    lower = F.transform("_named", lambda n: F.lower(n))
    once = F.transform("_named", lambda n, i: F.when(
        F.size(F.filter("_lower", lambda m: m == F.lower(n))) > 1, F.concat(n, i.cast("string"))).otherwise(n))
    heads = heads.select("_file", F.col("_seq").alias("_first"), "_width", named.alias("_named")).withColumn("_lower", lower)
    heads = materialise(heads.withColumn("_names", once).withColumn("_lower", F.transform("_names", lambda n: F.lower(n))), "heads")

    wide = heads.where(F.col("_width") > max_columns).select("_file").first()
    if wide:
        raise ValueError(f"more than {max_columns} columns in {wide['_file']}")
    wanted = F.array(*[F.lit(n.lower()) for n in required]).cast("array<string>")
    lacking = heads.where(F.size(F.array_except(wanted, "_lower")) > 0).select("_file").limit(20).collect()
    if lacking:
        raise ValueError(f"no header with all needed columns in {', '.join(r['_file'] for r in lacking)}")
    columns = heads.select(F.posexplode("_names").alias("place", "name")).groupBy(F.lower("name").alias("lower")).agg(
        F.min("place").alias("place"), F.min("name").alias("name")).collect()  # one row per column of the result
    columns = sorted(columns, key=lambda r: (r["place"], r["name"]))
    spelled = {n.lower(): n for n in known}
    names = [spelled.get(r["lower"], r["name"]) for r in columns]

    at = F.transform(F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>"),
                     lambda n: F.array_position("_lower", n).cast("int") - 1)
    maps = heads.select(key_of("_file").alias(KEY), "_first", F.col("_width").alias("_columns"), at.alias("_at"),
                        in_natural_order(F.col("_file")).alias("_in_order"))
    rows = member_join(rows.withColumn(KEY, key_of("_file")), materialise(maps, "maps"), "left", limits=limits)
    faults = F.col("_open") | (F.col("_width") > F.col("_columns")) | (F.col("_odd") & (F.col("_width") < F.col("_columns")))
    stop = F.raise_error(F.concat(F.lit("malformed record: "), F.coalesce("_start", F.lit(""))))
    return rows.where(F.col("_seq") > F.col("_first")).where(F.when(faults, stop).isNull()), names


def _field(place: int) -> Column:
    """The value of a record's column, null where its file has none or it is blank."""
    return blank_to_null(F.get("_cells", F.get("_at", F.lit(place))))


def read_exports(
    spark: SparkSession, path: str, sep: str = ";", max_columns: int = 200, limits: Limits = Limits()
) -> DataFrame:
    """A folder of exported runs as one table, each run named after its file or folder of files.

    Files need not have the same columns. Numbers and years are read as
    numbers; a run without ``article_id`` is numbered as it is read. The plan is the same for any number of files.
    """
    rows, names = _rows_by_header(spark, path, sep, "*.csv", [], _RUN_COLUMNS, max_columns, limits)
    if not names:
        raise ValueError(f"no exported run in {path}")
    file = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    run = F.regexp_extract(file, r"^.*?/([^/]+)\.csv(/|$)", 1)
    in_folder = F.regexp_extract(file, r"^.*?/([^/]+)\.csv(/|$)", 2) != ""
    number = F.when(in_folder, F.col("_seq")).otherwise(F.col("_seq") - F.col("_first") - 1)
    known = {"article_id": number}
    for place, name in enumerate(names):
        if name == "article_id":
            known[name] = F.when(F.get("_at", F.lit(place)) >= 0, _field(place).cast("bigint")).otherwise(number)
        elif name == "year":
            known[name] = year_number(_field(place))
        elif name != "run_id":
            known[name] = _field(place)
    return rows.select(run.alias("run_id"), *[value.alias(name) for name, value in known.items()])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sep: str = ",") -> DataFrame:
    """A file or folder of ``csv``, ``tsv`` or ``parquet``; the suffix decides unless ``fmt`` does."""
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        if sep not in CSV_SEPARATORS:
            raise ValueError(f"a csv file is separated by one of {CSV_SEPARATORS}, not {sep!r}")
        return read_delimited(spark, path, sep)
    if kind == "tsv":
        return read_delimited(spark, path, "\t")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"cannot read {path}: unknown format {kind!r}")


def read_folder(spark: SparkSession, path: str, sep: str = ",", max_columns: int = 200, limits: Limits = Limits()) -> DataFrame:
    """All ``.csv``, ``.tsv`` and ``.parquet`` files under a folder as one table, each read by its suffix.

    Every column is text, as delimited files have no types. Files need not have the same columns: they are matched by
    name, without regard to case, and a missing one is null; CSV files come first. A file with another suffix raises, an empty folder too.
    """
    if sep not in CSV_SEPARATORS:
        raise ValueError(f"a csv file is separated by one of {CSV_SEPARATORS}, not {sep!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")  # no contents
    suffix = F.regexp_extract("path", r"\.([^./]*)$", 1)
    kinds = {r["suffix"]: r["path"] for r in files.groupBy(suffix.alias("suffix")).agg(F.min("path").alias("path")).collect()}
    for kind, file in kinds.items():
        if kind.lower() not in ("csv", "tsv", "parquet"):
            raise ValueError(f"cannot read {file}: unknown format {kind!r}")
    if not kinds:
        raise ValueError(f"no table in {path}")
    tables = []
    for kind in sorted(kinds, key=str.lower):
        if kind.lower() == "parquet":
            reader = spark.read.option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).option("mergeSchema", True)
            table = reader.parquet(path)
            tables.append(table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns]))
        else:
            separator = sep if kind.lower() == "csv" else "\t"
            rows, names = _rows_by_header(spark, path, separator, f"*.{kind}", [], [], max_columns, limits)
            tables.append(rows.select(*[_field(place).alias(name) for place, name in enumerate(names)]))
    return union_sources(*tables)


def read_ieee(spark: SparkSession, path: str, max_columns: int = 200, limits: Limits = Limits()) -> DataFrame:
    """Every export in a folder as articles; further columns are kept.

    Files are read once and matched by column name, so columns and their order may differ between files.
    """
    needed = [*IEEE_RENAMES, *IEEE_DROPS]
    rows, names = _rows_by_header(spark, path, ",", "*.csv*", needed, needed, max_columns, limits)
    if not names:
        raise ValueError(f"no IEEE export in {path}")
    records = rows.select(
        F.col("_in_order").alias("ingest_file"),
        F.lit(0).alias("record_kind"),
        F.col("_seq").alias("ingest_seq"),
        *[_field(place).alias(name) for place, name in enumerate(names) if name not in IEEE_DROPS],
    )
    articles = replace_separators(records.withColumnsRenamed(IEEE_RENAMES).withColumn("source", F.lit("IEEE")))
    return articles.withColumn("year", year_number(F.col("year")))
