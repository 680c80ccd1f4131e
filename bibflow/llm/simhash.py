"""Near-duplicate documents by SimHash, found with a binary trie joined to itself.

A fingerprint's bits from the highest down are a path in a binary trie. Two
nodes of one depth are visited together with the number of bits in which their
paths differ; a pair whose number exceeds the budget is dropped with everything
below it. The top of the trie is walked as a table of node pairs, each of which
becomes a group of its own; the rest of the walk goes on within the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.llm.components import connected_components
from bibflow.llm.words import ROW, batches, lower_words, numbered, texts, with_row
from bibflow.runtime import materialise

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 bits; each is set if it is set in over half the hashes of the text's shingles."""
    words = lower_words(text)
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(last)
    for cut in range(0, total, _CHUNK):
        hashes = np.fromiter(
            [digest(joined[s:e], SEED) for s, e in zip(starts[cut:cut + _CHUNK], last[cut:cut + _CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_llm_row``, ``doc_id`` and the signed 64-bit ``fingerprint`` of every row.

    Hashes are XXH64 with seed 42 of UTF-8 shingles, repeats included. A text of
    fewer words is one shingle; one without words, null included, has
    fingerprint zero. Only the two columns are read.
    """
    return _prints(with_row(docs), shingle, doc_id, text)


def _prints(rows: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t, shingle) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("doc_id"), pa.array(values.view(np.int64))],
            names=[ROW, "doc_id", "fingerprint"])

    source = rows.select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches(run), f"{ROW} bigint, doc_id {kind}, fingerprint bigint")


def _pairs_of_nodes(spark, depth: int, budget: int) -> DataFrame:
    """Node pairs (u, v), u <= v, of the trie's level ``depth`` that differ in ``budget`` bits or fewer."""
    pairs = spark.range(1).select(F.lit(0).alias("u"), F.lit(0).alias("v"), F.lit(0).alias("e"))
    for level in range(depth):
        step = F.explode(F.array(*[
            F.struct((F.col("u") * 2 + a).alias("u"), (F.col("v") * 2 + b).alias("v"), (F.col("e") + (a ^ b)).alias("e"))
            for a in (0, 1) for b in (0, 1)])).alias("p")
        pairs = pairs.select(step).select("p.*").where(f"u <= v AND e <= {budget}")
        if level == 7:  # a table of many rows from here on
            pairs = pairs.repartition("u", "v")
    return pairs.select("u", "v")


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places one label, the smallest of theirs."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def linked_labels(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0,
                  brute: int = 256, most: int = 1 << 18) -> np.ndarray:
    """Labels of the sorted arrays ``left`` and ``right``, equal where links between the two connect.

    Without ``right``, the links are those within ``left``. Pairs of nodes are
    ranges of the sorted arrays; a pair with at most ``brute`` comparisons left is
    compared outright. At most ``most`` pairs of nodes are expanded at once.
    """
    same = right is None
    other = left if same else right
    shift = 0 if same else len(left)
    labels = np.arange(len(left) + (0 if same else len(right)))
    stack = [(depth, np.array([[0, len(left), 0, len(other), 0]], np.int64))]
    while stack:
        bit, pairs = stack.pop()
        work = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (work <= brute) | (bit == 64)
        compared, pairs = pairs[small], pairs[~small]
        for part in _parts(compared, work[small], most * 8):
            width = part[:, 3] - part[:, 2]
            size = (part[:, 1] - part[:, 0]) * width
            which = np.repeat(np.arange(len(part)), size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i = part[which, 0] + place // width[which]
            j = part[which, 2] + place % width[which]
            near = np.bitwise_count(left[i] ^ other[j]) <= budget
            _merge(labels, i[near], j[near] + shift)
        if not len(pairs):
            continue
        cut_a, cut_b = _cuts(left, pairs[:, 0], pairs[:, 1], bit), _cuts(other, pairs[:, 2], pairs[:, 3], bit)
        children = []
        for a in (0, 1):
            for b in (0, 1):
                child = np.stack([
                    cut_a if a else pairs[:, 0], pairs[:, 1] if a else cut_a,
                    cut_b if b else pairs[:, 2], pairs[:, 3] if b else cut_b, pairs[:, 4] + (a ^ b)], axis=1)
                keep = (child[:, 4] <= budget) & (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3])
                if same:  # each pair of nodes once, a node with itself included
                    keep &= child[:, 0] <= child[:, 2]
                children.append(child[keep])
        below = np.concatenate(children)
        stack += [(bit + 1, below[k:k + most]) for k in range(0, len(below), most)]
    return labels


def _parts(pairs: np.ndarray, work: np.ndarray, most: int) -> Iterator[np.ndarray]:
    bounds = np.cumsum(work)
    start = 0
    while start < len(pairs):
        done = bounds[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(bounds, done + most, side="right")))
        yield pairs[start:end]
        start = end


def _cuts(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For each node, the place of its first value with ``bit`` set."""
    keep = np.uint64(0xFFFFFFFFFFFFFFFF << (64 - bit) & 0xFFFFFFFFFFFFFFFF)
    target = (values[low] & keep) | np.uint64(1 << (63 - bit))
    return np.clip(np.searchsorted(values, target), low, high)


def trie_links(prints: DataFrame, budget: int = 4, node_rows: int = 1 << 13, most_depth: int = 16) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fingerprint`` values within ``budget`` bits of each other.

    Not every link is returned: each pair of nodes gives a spanning forest of its
    own, which has the same components and at most a row per fingerprint.

    The walk is split at the depth at which a node has about ``node_rows``
    fingerprints. A node with more, because fingerprints crowd there, is dealt
    into slices by hash, and each pair of slices is walked by itself. A slice
    travels as one packed row of at most a few times ``node_rows`` numbers.
    """
    spark = prints.sparkSession
    depth = min(most_depth, max(1, (prints.count() // node_rows).bit_length()))
    placed = prints.select("fingerprint", F.shiftrightunsigned("fingerprint", 64 - depth).cast("int").alias("node"))
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / (2 * node_rows)).cast("int").alias("slices"))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("slices")).cast("int")
    # At most 2**most_depth nodes are broadcast, whatever the input.
    packed = placed.join(F.broadcast(sizes), "node").groupBy("node", mine.alias("slice")).agg(
        F.array_sort(F.collect_list("fingerprint")).alias("packed"))
    packed = materialise(packed, "nodes")

    def side(letter: str) -> DataFrame:
        return packed.select(F.col("node").alias(letter), F.col("slice").alias(f"s{letter}"))

    pairs = _pairs_of_nodes(spark, depth, budget).join(side("u"), "u").join(side("v"), "v").where("u < v OR su <= sv")
    own = F.expr("u = v AND su = sv")
    at_u, at_v = (
        packed.withColumnsRenamed({"node": n, "slice": f"s{n}", "packed": name}) for n, name in (("u", "left"), ("v", "right")))
    tasks = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = pairs.join(at_u, ["u", "su"]).join(at_v, ["v", "sv"]).select(
        "u", "v", "left", F.when(~own, F.col("right")).alias("right")).repartition(tasks, "u", "v", F.xxhash64("left", "right"))

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros((2, 0), np.uint64)]
        for left, right in zip(batch.column("left"), batch.column("right")):
            a = np.sort(left.values.to_numpy().view(np.uint64))
            b = np.sort(right.values.to_numpy().view(np.uint64)) if right.is_valid else None
            labels = linked_labels(a, b, budget)
            nodes = a if b is None else np.concatenate([a, b])
            hung = np.flatnonzero(labels != np.arange(len(labels)))
            found.append(np.stack([nodes[labels[hung]], nodes[hung]]))
        ends = np.concatenate(found, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return work.select("left", "right").mapInArrow(batches(walk), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``_llm_row``, ``doc_id``, ``fingerprint`` and ``component_id`` for every row.

    Fingerprints with at most ``budget`` differing bits are linked, and a
    component's id is the smallest document id in it (nulls are ignored unless
    it has no other). Equal texts and equal fingerprints are one node of the
    graph, so repeated rows and large groups of copies cost no links. Empty
    tables give no rows. ``docs`` should be a stored table: see ``with_row``.
    """
    return _judged(with_row(docs), shingle, budget, doc_id, text)


def _judged(rows: DataFrame, shingle: int, budget: int, doc_id: str, text: str) -> DataFrame:
    prints = materialise(_prints(rows, shingle, doc_id, text), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(trie_links(nodes.select("fingerprint"), budget))
    labelled = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = labelled.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select(ROW, "doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Ties of ids, and components without ids, keep the row that comes first. All columns are kept.
    """
    rows = numbered(docs)
    judged = _judged(rows, shingle, budget, doc_id, text)
    # A component is known by one of its fingerprints' smallest ids; without ids, by its fingerprint.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias("row")))
    stays = judged.groupBy(*group).agg(first.alias("first")).select(F.col("first.row").alias(ROW))
    return rows.join(stays, ROW, "left_semi").drop(ROW)
