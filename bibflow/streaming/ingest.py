"""Landed PubMed files into the article table, file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibflow.operators.harmonise import conform
from bibflow.sinks import not_taken, write_batch
from bibflow.sources.pubmed import parse_bodies, stream_bodies


def ingest_pubmed(
    spark: SparkSession,
    landed: str,
    table: str,
    checkpoint: str,
    run_id: str,
    files_per_batch: int = 1000,
    **trigger,
) -> StreamingQuery:
    """Start the ingest. Without a trigger it takes what has landed and stops.

    The stream keeps no state between batches; the checkpoint remembers which
    files are done, and the table which files it has. So a batch that is repeated after a
    failure, or a new checkpoint over the same folder, adds only what is not there yet.
    Files that the table has are not parsed, and a batch of such files alone writes nothing.
    """
    def write(batch, number):
        new = not_taken(batch, table)
        if not new.select("ingest_path").isEmpty():
            records = parse_bodies(new).withColumn("run_id", F.lit(run_id))
            write_batch(conform(records, keep_extra=True).drop("publication_type"), table, number)

    return (
        stream_bodies(spark, landed, files_per_batch).withColumn("run_id", F.lit(run_id)).writeStream
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
