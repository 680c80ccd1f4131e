"""Session set-up and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Enough shuffle partitions that each holds about 256 MB and every core has one."""
    return max(cores, min(-(-input_bytes // (256 << 20)), 200_000))


def session(app: str = "bibflow", input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Give the size of the input on a cluster: shuffles are cut accordingly and
    merged again at run time where less data arrives.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if input_bytes is not None:
        wanted = shuffle_partitions(input_bytes, spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="bibflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    path = f"{shared_folder(spark)}/bibflow-{uuid.uuid4().hex}-{label}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors, and later passes
    read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, *by: str) -> DataFrame:
    """Spread an input of fewer splits than cores over all cores.

    For work that is heavy per row. A larger input already has enough splits
    and is left alone, so less than a split per core is ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def scratch_mark() -> int:
    """How many intermediate tables there are by now, for ``drop_scratch``."""
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete the intermediate tables this process wrote. Call when results are saved.

    With ``since``, a mark, only those that are newer; the ``last`` ones stay.
    """
    conf = spark._jsc.hadoopConfiguration()
    end = max(since, len(_written) - last)
    for name in _written[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[since:end]
