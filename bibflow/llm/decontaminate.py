"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of consecutive words. A window is the set of its
shingles, placed; a document holds the window if it holds all of them in place.
Shingles are ordered by how rare they are in the documents, and as all must be
there, the rarest alone is the necessary prefix: only its occurrences are joined.
Positions and lengths then bound where the window can lie, and its words are
compared with the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.llm.words import ROW, Bloom, Rolling, WordHashes, alnum_words, batches, numbered, sliced, texts, with_row
from bibflow.runtime import materialise

_BASE = 0x9E3779B97F4A7C15


def _shingles(words: list[bytes], width: int, hashes: WordHashes, rolling: Rolling) -> np.ndarray:
    sums = rolling.sums(hashes.array(words))
    starts = np.arange(max(0, len(words) - width + 1))
    # The width is part of the hash: short items have shingles of their own length.
    return rolling.of(sums, starts, width) + np.uint64(width * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)


def item_windows(items: DataFrame, window: int = 13, shingle: int = 5, item_id: str = "item_id",
                 text: str = "text") -> DataFrame:
    """``item`` (id as text), ``words`` (of one window, joined), ``width`` and ``parts`` (hash and offset).

    An item of fewer words than ``window`` is one window; one without words has none.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, rolling, rows = WordHashes(), Rolling(_BASE), []
        for item, value in zip(batch.column("item").to_pylist(), texts(batch.column("text"))):
            words = alnum_words(value)
            if not words:
                continue
            width = min(window, len(words))
            size = min(shingle, width)
            found = _shingles(words, size, hashes, rolling).view(np.int64).tolist()
            for start in range(len(words) - width + 1):
                parts = [{"hash": found[start + k], "offset": k} for k in range(width - size + 1)]
                rows.append({"item": item, "words": b" ".join(words[start:start + width]).decode(), "width": width, "parts": parts})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("item", pa.string()), ("words", pa.string()), ("width", pa.int32()),
            ("parts", pa.list_(pa.struct([("hash", pa.int64()), ("offset", pa.int32())])))]))

    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return source.mapInArrow(batches(run), "item string, words string, width int, parts array<struct<hash:bigint,offset:int>>")


def _occurrences(docs: DataFrame, bloom: Bloom, sizes: list[int], window: int) -> DataFrame:
    """Every document row with its number of words and its hits: shingles that an item may hold.

    A hit has its position, hash, and the words up to ``window - 1`` before and ``window`` after it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bloom.words, sizes))

    def run(stream):
        words_of_bloom, widths = shared.value
        bits, hashes, rolling = Bloom(words_of_bloom), WordHashes(), Rolling(_BASE)
        hit = pa.struct([("pos", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("near", pa.string())])
        for batch in sliced(stream):
            counts, lists = [], []
            for value in texts(batch.column("text")):
                words, hits = alnum_words(value), []
                for width in widths:
                    found = _shingles(words, width, hashes, rolling)
                    for pos in np.flatnonzero(bits.has(found)).tolist():
                        at = max(0, pos - window + 1)
                        hits.append({"pos": pos, "hash": int(found[pos].view(np.int64)), "at": at,
                                     "near": b" ".join(words[at:pos + window]).decode()})
                counts.append(len(words))
                lists.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(hit))],
                names=[ROW, "doc_id", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(ROW, "doc_id", "text").mapInArrow(
        run, f"{ROW} bigint, doc_id {kind}, n_words bigint, hits array<struct<pos:int,hash:bigint,at:int,near:string>>")


def _necessary(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """Each distinct window's rarest shingle, for windows all of whose shingles occur: hash, offset, words, width."""
    often = hits.groupBy("hash").agg(F.count("*").alias("often"))
    distinct = windows.groupBy("words").agg(F.first("width").alias("width"), F.first("parts").alias("parts"))
    parts = distinct.select("words", "width", F.size("parts").alias("size"), F.explode("parts").alias("part"))
    known = parts.select("words", "width", "size", "part.hash", "part.offset").join(often, "hash")
    rarest = F.min(F.struct("often", "hash", "offset")).alias("rarest")
    chosen = known.groupBy("words", "width", "size").agg(F.count("*").alias("there"), rarest).where("there = size")
    return chosen.select("rarest.hash", "rarest.offset", "words", "width")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20,
                  doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per document row: ``_llm_row, doc_id, n_words, n_hit, n_items, items, contaminated``.

    Words are runs of ASCII letters (in lower case), digits and non-ASCII
    characters. A document word inside an occurrence of a window is hit;
    ``items`` has the ids, as sorted strings, of the items with an occurring
    window. A document is contaminated if it has hits and ``share * n_hit >= n_words``.

    Null and empty texts have no words and never match; an item with a null id is
    the item ''. Items may repeat. Repeated documents are judged one by one.
    ``docs`` should be a stored table: see ``with_row``.

    Documents are read once. What is sent to every task is a Bloom filter of at
    most 32 MB of all item shingles, whatever the size of the benchmark; joins follow it.
    """
    return _judged(with_row(docs), items, window, shingle, share, doc_id, item_id, text)


def _judged(rows: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20,
            doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    windows = materialise(item_windows(items, window, shingle, item_id, text), "windows")
    hashes = windows.select(F.explode("parts").alias("part")).select("part.hash").distinct()
    sizes = sorted(min(shingle, r.width) for r in windows.select("width").distinct().collect())  # at most ``window`` rows
    source = rows.select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    read = materialise(_occurrences(source, Bloom.of(hashes, "hash"), sorted(set(sizes)), window), "occurrences")
    hits = read.select(ROW, "n_words", F.explode("hits").alias("hit")).select(ROW, "n_words", "hit.*")
    start = F.col("pos") - F.col("offset")
    inside = hits.join(_necessary(windows, hits), "hash").withColumn("start", start).where(
        (F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("near", " "), F.col("start") - F.col("at") + 1, F.col("width")), " ")
    found = inside.where(there == F.col("words")).select(ROW, "words", "start", (F.col("start") + F.col("width")).alias("end"))
    found = materialise(found.distinct(), "found")

    span = F.struct("start", "end")
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort(F.collect_set(span)), begin, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end")))["n"]
    n_hit = found.groupBy(ROW).agg(covered.cast("bigint").alias("n_hit"))
    of_window = windows.groupBy("words").agg(F.collect_set("item").alias("ids"))
    ids = found.select(ROW, "words").distinct().join(of_window, "words").groupBy(ROW).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    judged = read.select(ROW, "doc_id", "n_words").join(n_hit, ROW, "left").join(ids, ROW, "left")
    hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    return judged.select(
        ROW, "doc_id", "n_words", hit.cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    rows = numbered(docs)
    judged = _judged(rows, items, doc_id=doc_id, **options)
    return rows.join(judged.where("contaminated").select(ROW), ROW, "left_anti").drop(ROW)
