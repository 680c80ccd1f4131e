"""Repeated passages by difference-cover anchors.

The set {0, 1, 3, 8, 12, 18} is a difference cover modulo 31: for any two
positions there is a step below 31 that takes both to positions of the set. So
two equal runs of 50 words share an anchor, that is, 20 equal words at positions
which both lie in the set modulo 31, within the runs. Only anchors are hashed
over the whole corpus. Where an anchor also occurs elsewhere, the runs of 50
words around it are hashed, and for each the smallest document that has it is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.llm.words import ROW, Bloom, Rolling, WordHashes, batches, numbered, plain_words, sliced, texts
from bibflow.plans.skew import KEY, member_join
from bibflow.runtime import materialise

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _words_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of a batch, one after another, and how many each text has."""
    words: list[bytes] = []
    counts = np.zeros(batch.num_rows, np.int64)
    for k, value in enumerate(texts(batch.column("text"))):
        before = len(words)
        words += plain_words(value)
        counts[k] = len(words) - before
    return words, counts


def _anchors(docs: DataFrame, window: int, shared: Bloom | None = None) -> DataFrame:
    """``_llm_row``, ``pos`` and ``hash`` of every anchor of a document that is long enough for a window.

    With ``shared``, only of anchors that may be in it. Later copies have none.
    """
    anchor = window - PERIOD + 1
    bits = None if shared is None else docs.sparkSession.sparkContext.broadcast(shared.words)

    def run(stream):
        hashes, rolling = WordHashes(), Rolling(_BASES[0])
        known = None if bits is None else Bloom(bits.value)
        for batch in sliced(stream, rows=4096, size=1 << 20):
            words, counts = _words_of(batch)
            if not words:
                continue
            doc = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            size = counts[doc]
            at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + anchor <= size) & (size >= window))
            found = rolling.of(rolling.sums(hashes.array(words)), at, anchor)
            if known is not None:
                kept = known.has(found)
                at, found = at[kept], found[kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW).take(pa.array(doc[at])), pa.array(place[at].astype(np.int32)), pa.array(found.view(np.int64))],
                names=[ROW, "pos", "hash"])

    return docs.where("NOT later").select(ROW, "text").mapInArrow(run, f"{ROW} bigint, pos int, hash bigint")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """``_llm_row``, ``doc_id``, ``start`` and a 96-bit hash of every window that holds an anchor at ``places``."""
    reach = PERIOD - 1
    kind = candidates.schema["doc_id"].dataType.simpleString()

    def run(stream):
        pairs = [(WordHashes(seed, 100_000), Rolling(base)) for seed, base in zip((1, 2), _BASES)]
        for batch in sliced(stream, size=1 << 20):
            which, begin, one, two = [], [], [], []
            for k, (value, places) in enumerate(zip(texts(batch.column("text")), batch.column("places"))):
                words = plain_words(value)
                at = places.values.to_numpy().astype(np.int64)
                edges = np.zeros(len(words) + 2, np.int64)
                np.add.at(edges, np.maximum(0, at - reach), 1)
                np.add.at(edges, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(edges)[:max(0, len(words) - window + 1)] > 0)
                first, second = (r.of(r.sums(h.array(words)), starts, window) for h, r in pairs)
                which.append(np.full(len(starts), k))
                begin.append(starts.astype(np.int32))
                one.append(first.view(np.int64))
                two.append((second >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if which:
                index = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW).take(index), batch.column("doc_id").take(index),
                     *[pa.array(np.concatenate(x)) for x in (begin, one, two)]],
                    names=[ROW, "doc_id", "start", "h1", "h2"])

    return candidates.select(ROW, "doc_id", "text", "places").mapInArrow(
        run, f"{ROW} bigint, doc_id {kind}, start int, h1 bigint, h2 int")


_HASH = "_llm_hash"


def _maybe(docs: DataFrame, key: str, bits, wanted: bool = True) -> DataFrame:
    """``docs`` whose ``key`` may be (or is not) among those in the broadcast ``bits``. Nothing is shuffled."""
    docs = docs.withColumn(_HASH, F.xxhash64(key))

    def keep(stream):
        known = Bloom(bits.value)
        for batch in sliced(stream):
            yield batch.filter(pa.array(known.has(batch.column(_HASH).to_numpy().view(np.uint64)) == wanted))

    return docs.mapInArrow(keep, docs.schema).drop(_HASH)


def _bits_of(rows: DataFrame, key: str):
    return rows.sparkSession.sparkContext.broadcast(Bloom.of(rows.select(F.xxhash64(key).alias(_HASH)), _HASH).words)


def _with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with ``later``: the same text also stands under a smaller id. Row numbers are written down.

    Texts that stand once, by far the most, stay where they are. Texts are equal by 128-bit hashes.
    """
    keyed = docs.withColumn(KEY, F.md5("text"))
    copied = keyed.where("text != '' AND doc_id IS NOT NULL").groupBy(KEY).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(KEY, "first")
    copied = materialise(copied, "copied")
    bits, columns = _bits_of(copied, KEY), ["doc_id", "text"]
    joined = member_join(_maybe(keyed, KEY, bits), copied, "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("later")
    alone = _maybe(keyed, KEY, bits, wanted=False).select(*columns, F.lit(False).alias("later"))
    return numbered(joined.select(*columns, later).unionByName(alone))


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """``_llm_row`` and ``starts`` of the windows that also start in a document with a smaller id.

    ``docs`` has ``_llm_row``, ``doc_id``, ``text`` and ``later``, and rows of a text that also stands
    under a smaller id take no part: all their windows start there. Counts and minima are
    reduced within tasks before they are shuffled, and a passage that a great
    many documents share is split among tasks by the joins, so no passage is
    compared pair by pair. Bloom filters of at most 32 MB keep rows out of the
    shuffles; the joins after them are exact.
    """
    shared = materialise(
        _anchors(docs, window).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "anchors")
    common = _anchors(docs, window, Bloom.of(shared, "hash")).join(shared, "hash", "left_semi")
    places = materialise(common.groupBy(ROW).agg(F.collect_list("pos").alias("places")), "places")
    candidates = materialise(_maybe(docs.drop("later"), ROW, _bits_of(places, ROW)).join(places, ROW), "candidates")
    found = _windows(candidates, window)
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
    return later.groupBy(ROW).agg(F.collect_list("start").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: ``_llm_row, doc_id, n_words, n_removed`` and ``kept``, its words less repeated passages.

    Words are runs without ASCII white space. Every word is removed that lies in
    a run of ``window`` words which also starts in a document with a smaller id;
    runs are judged on the input. ``kept`` has the other words, joined by one space.

    Null and empty texts have no words. Documents of equal id do not count as
    smaller than each other, and a null id is neither smaller nor larger than any,
    so such rows lose nothing to each other. A text that also stands under a smaller id goes whole. Rows are judged one by one, by numbers
    that are written down first with the two columns. Windows count as equal by 96-bit hashes.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    source = _with_copies(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = source.schema["doc_id"].dataType.simpleString()
    starts = materialise(repeated_windows(source, window), "repeats")
    bits = _bits_of(starts, ROW)
    schema = f"{ROW} bigint, doc_id {kind}, n_words bigint, n_removed bigint, kept string"

    def cut(batch: pa.RecordBatch, begins) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        for value, begin, later in zip(texts(batch.column("text")), begins, batch.column("later").to_pylist()):
            words = plain_words(value)
            counts.append(len(words))
            if later and len(words) >= window:
                words = []
            elif begin is not None and begin.is_valid:
                at = begin.values.to_numpy()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                stay = np.cumsum(edges)[:-1] == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.string())], names=[ROW, "doc_id", "n_words", "n_removed", "kept"])

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        has = Bloom(bits.value).has(batch.column(_HASH).to_numpy().view(np.uint64))
        batch = batch.filter(pa.array(~has))
        return cut(batch, [None] * batch.num_rows)

    hit = _maybe(source, ROW, bits).join(starts, ROW, "left").mapInArrow(batches(lambda b: cut(b, b.column("starts"))), schema)
    return hit.unionByName(source.withColumn(_HASH, F.xxhash64(ROW)).mapInArrow(batches(clean), schema))
