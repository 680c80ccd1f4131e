"""A training corpus out of raw documents, in stages that are each written and read again.

1. Quality: documents that the rule ensemble rejects go.
2. Lines: per source, lines on more than a twentieth of its distinct texts go. A source
   is much wider than one site, so its boilerplate is on a smaller share of it. Copies
   of a text count once, as they are still there: only the next stage drops them.
3. Near copies: documents are linked if their SimHash fingerprints of four-word
   shingles differ in at most 4 of 64 bits. Of each linked group the smallest id stays.
4. Benchmark: documents of which a twentieth or more lies in benchmark passages go.
5. Tokens: ids of whole texts, decoded again to check them.

All but the last keep the columns of ``documents``; ``n_chars`` follows the text
where a stage changes it. SQL can express neither the learned rules nor the
tokenizer, so ``ORACLE_SQL`` is None and tests use brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflow.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from bibflow.llm.shipping import ship
from bibflow.runtime import drop_scratch, materialise, scratch_mark

LABELLED_ROWS = 20_000
QUALITY = 0.3
LINE_RATIO, LINE_DOCUMENTS = 0.05, 10
SHINGLE, BITS = 4, 4
RANKS = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=LABELLED_ROWS)
    return quality.drop_low_quality(docs, model, QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_DOCUMENTS, copies_once=True)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_duplicates(docs, SHINGLE, BITS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs``, ``ids`` (little-endian unsigned 32-bit), ``n_tokens``, and ``intact``: they decode to the text."""
    ship(spark)
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return byte_bpe.encode(docs, ranks, pattern, decoded="decoded").select(
        *docs.columns, "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("intact"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level bpe", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Once a stage is written, the tables inside it and its input are dropped.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = scratch_mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        drop_scratch(spark, since=start, last=1)
    return docs
