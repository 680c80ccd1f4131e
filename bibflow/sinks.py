"""Writing runs, comparisons and marks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibflow.operators.harmonise import assign_ids

# Names of exported files, after their time stamp.
RUN_SUFFIX = "complete_articles.csv"
COMPARISON_SUFFIX = "combined_search_articles.csv"


# A run lies in folders run_id=<run>/part=<commit>. Which of them count is said by the newest complete
# snapshot in _manifest, which is written last: what a writer leaves that was stopped before is never read.
PARTS = ["run_id", "part"]
WHOLE = "all"
_FILE = "_landed_file"
_MANIFEST = "run_id STRING, name STRING, part STRING, folder STRING, rows BIGINT, fields STRING"
_SNAPSHOTS, _LEDGER = "_manifest/snapshots", "_manifest/files"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The article table, with run ids as the text they were written as: ``007`` stays ``007``.

    It has the columns of all its runs; where a run was written without one, it is null.
    A table without a manifest, as other writers leave it, is read with the columns of all its files.
    """
    return _table(spark, path).drop("part", _FILE)


def _table(spark: SparkSession, path: str) -> DataFrame:
    listed = _snapshot(spark, path)
    if listed is None:
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        texts = [T.StructField(f.name, T.StringType() if f.name in PARTS else f.dataType) for f in found]
        return spark.read.schema(T.StructType(texts)).parquet(path)
    shapes = [T.StructType.fromJson(json.loads(r.fields)) for r in listed.select("fields").distinct().orderBy("fields").collect()]
    schema = T.StructType([*merged(shapes), *[T.StructField(c, T.StringType()) for c in PARTS]])
    if not shapes:
        return spark.createDataFrame([], schema)
    live = listed.select(F.col("run_id").alias("_run"), F.col("part").alias("_part"))
    data = spark.read.schema(schema).parquet(path)
    return data.join(live, (F.col("part") == F.col("_part")) & F.col("run_id").eqNullSafe(F.col("_run")), "left_semi")


def merged(shapes: list[T.StructType]) -> list[T.StructField]:
    """The columns of all ``shapes`` by name, each where it first appears. One name with two types raises."""
    fields: dict[str, T.StructField] = {}
    for field in (f for shape in shapes for f in shape):
        known = fields.setdefault(field.name, T.StructField(field.name, field.dataType))
        if known.dataType != field.dataType:
            raise ValueError(f"column {field.name} was written as {known.dataType.simpleString()} and as {field.dataType.simpleString()}")
    return list(fields.values())


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete snapshots, oldest first."""
    fs, pattern = _files(spark, f"{path}/{_SNAPSHOTS}/v*/_SUCCESS")
    return sorted(str(f.getPath().getParent().toString()) for f in fs.globStatus(pattern) or [])


def _snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    found = _versions(spark, path)
    return spark.read.schema(_MANIFEST).parquet(found[-1]) if found else None


def write_run(articles: DataFrame, path: str) -> None:
    """Add runs to the article table. Writing a run again replaces all of it.

    A run that a stream has written is left to it and raises.
    """
    _commit(articles, path, WHOLE)


def write_batch(records: DataFrame, path: str, batch: int) -> None:
    """Add a batch of a stream to its run, which must not have been written at once.

    Records with ``ingest_path`` are taken once per landed file, whatever the batch and
    the checkpoint: files that are in the table already are left out. A file counts by its path. Without that
    column, writing a batch again replaces it.
    """
    if "ingest_path" not in records.columns:
        return _commit(records, path, f"batch-{batch:09d}")
    _commit(not_taken(records, path).withColumnRenamed("ingest_path", _FILE), path, f"files-{uuid.uuid4().hex}")


def not_taken(rows: DataFrame, path: str) -> DataFrame:
    """The rows, by ``run_id`` and ``ingest_path``, of landed files that the table has not taken yet."""
    taken = _taken(rows.sparkSession, path.rstrip("/"))
    if taken is None:
        return rows
    same = F.col("run_id").cast("string").eqNullSafe(F.col("_run")) & (F.col("ingest_path") == F.col("_file"))
    return rows.join(taken, same, "left_anti")


def _taken(spark: SparkSession, path: str) -> DataFrame | None:
    """Run and path of every landed file that a commit in the snapshot took."""
    listed = _snapshot(spark, path)
    fs, pattern = _files(spark, f"{path}/{_LEDGER}/part=*")
    if listed is None or not fs.globStatus(pattern):
        return None
    ledger = spark.read.schema("_run STRING, _file STRING, part STRING").parquet(f"{path}/{_LEDGER}")
    return ledger.join(listed.select("part"), "part", "left_semi").select("_run", "_file")


def write_screened(screened: DataFrame, path: str) -> None:
    """Write marked runs to a table of their own. Other runs in it stay."""
    _commit(screened, path, WHOLE)


def write_rejected(failed: DataFrame, path: str, run_id: str) -> None:
    """Keep landed answers and records that are none, with the reason, apart from the articles."""
    _commit(failed.select(F.lit(run_id).alias("run_id"), "file", "details"), path, WHOLE)


def _commit(df: DataFrame, path: str, name: str) -> None:
    """Write the rows under a part of their own, then a snapshot in which it stands in the place of what it replaces.

    Partitioned by run and part alone: with the source as well, a source that a run no
    longer has would stay behind. Of two writers at once that saw the same snapshot one fails.
    """
    spark, part = df.sparkSession, f"{name}.{uuid.uuid4().hex}"
    path = path.rstrip("/")
    seen = _versions(spark, path)
    df = df.withColumn("run_id", F.col("run_id").cast("string")).withColumn("part", F.lit(part))
    df.write.mode("append").partitionBy(*PARTS).parquet(path)
    fs, pattern = _files(spark, f"{path}/run_id=*/part={part}")
    folders = [f.getPath() for f in fs.globStatus(pattern) or []]
    if not folders:
        return  # no rows
    shape = T.StructType([f for f in df.schema if f.name not in PARTS])
    texts = T.StructType([*shape, *[T.StructField(c, T.StringType()) for c in PARTS]])
    written = spark.read.schema(texts).option("basePath", path).parquet(*[str(f.toString()) for f in folders])
    folder = F.regexp_replace(F.min(F.col("_metadata.file_path")), "/[^/]*$", "").alias("folder")
    new = written.groupBy("run_id").agg(folder, F.count("*").alias("rows")).select(
        "run_id", F.lit(name).alias("name"), F.lit(part).alias("part"), "folder", "rows", F.lit(shape.json()).alias("fields"))
    new = spark.createDataFrame(new.collect(), _MANIFEST)
    listed = spark.read.schema(_MANIFEST).parquet(seen[-1]) if seen else spark.createDataFrame([], _MANIFEST)
    runs = new.select(F.col("run_id").alias("_run"))
    of_these = listed.join(F.broadcast(runs), F.col("run_id").eqNullSafe(F.col("_run")), "left_semi")
    mixed = of_these.where((F.col("name") == WHOLE) != F.lit(name == WHOLE)).select("run_id", "name").first()
    if mixed is not None:
        for folder in folders:
            fs.delete(folder, True)
        by = "at once; give the stream" if mixed["name"] == WHOLE else "by a stream; write the new one under"
        raise ValueError(f"run {mixed['run_id']} was written {by} another id")
    replaced = of_these.where(F.col("name") == name).collect()
    if _FILE in shape.names:
        written.select(F.col("run_id").alias("_run"), F.col(_FILE).alias("_file"), F.lit(part).alias("part")).distinct().write.mode(
            "append").partitionBy("part").parquet(f"{path}/{_LEDGER}")
    gone = spark.createDataFrame(replaced, _MANIFEST).select(F.col("run_id").alias("_run"), F.col("part").alias("_part"))
    stays = listed.join(F.broadcast(gone), F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("part") == F.col("_part")), "left_anti")
    number = 1 + (int(seen[-1].rsplit("/v", 1)[1]) if seen else 0)
    stays.unionByName(new).coalesce(1).write.parquet(f"{path}/{_SNAPSHOTS}/v{number:012d}")
    # Only now may what was replaced go; readers of the snapshot before have its parts no more.
    for row in replaced:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["folder"])), True)
    for old in seen[:-1]:
        fs, folder = _files(spark, old)
        fs.delete(folder, True)


def export_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "error", file_rows: int = 0) -> None:
    """Delimited files with a header. Line breaks, quotes and outer blanks of fields survive.

    With ``file_rows``, a task goes on in a new file after so many rows.
    """
    (
        df.write.mode(mode)
        .option("maxRecordsPerFile", file_rows)
        .option("sep", sep)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_run(articles: DataFrame, folder: str, stamp: str) -> str:
    """Export a run that has its ``article_id``; returns the path."""
    path = f"{folder.rstrip('/')}/{stamp}_{RUN_SUFFIX}"
    first = [c for c in articles.columns if c == "article_id"]
    export_csv(articles.select(*first, *[c for c in articles.columns if c not in first]), path)
    return path


def number_comparison(compared: DataFrame) -> DataFrame:
    """New numbers over old rows, then added rows; the number from the run is kept beside it.

    Of a comparison that is compared again, the number that it had there is kept.

    Takes the result of ``compare_runs(..., with_side=True)``.
    """
    renamed = compared.drop("source_article_id").withColumnRenamed("article_id", "source_article_id")
    return assign_ids(renamed, ["side", "source_article_id"]).drop("side")


def export_comparison(compared: DataFrame, folder: str, stamp: str) -> str:
    """Export a comparison; returns the path."""
    path = f"{folder.rstrip('/')}/{stamp}_{COMPARISON_SUFFIX}"
    export_csv(number_comparison(compared), path)
    return path
