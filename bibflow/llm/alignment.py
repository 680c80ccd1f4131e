"""Tokens of two tokenizers brought together by the bytes that they cover.

Each text is encoded by both. The byte offsets at which tokens end go into a
dictionary per tokenizer, from end to index; ends in both dictionaries, sorted,
cut the two lists of ids into groups that cover the same bytes. Within a group
every token is linked to those of the other side whose bytes it overlaps. How
many documents hold a pair of ids linked is counted over the corpus, and each
document's links are then held against those counts.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from bibflow.llm.byte_bpe import split_safely
from bibflow.llm.words import ROW, sliced, with_row
from bibflow.runtime import materialise

PIECE_CHARS = 1 << 18
#: How byte-level tokenizers cut a text before their merges. Fixed value.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The mark of a space in pieces. Fixed value.
SPACE = "▁"
#: Pairs that are sent to all tasks as sorted arrays of 16 bytes a pair; more are joined.
MOST_PAIRS = 6_000_000
_BLOCK = 200_000
# A space behind something else ends a piece, and so it may stand at the start of the next one.
_AT_SPACE = regex.compile(r"(?<=[^\s▁])(?= [^\s▁])")


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Side:
    """One tokenizer: the bytes of each id, and ids of many texts."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.bytes = np.array(tokens, dtype=object)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.encode = encode
        #: An id and what stands behind it: a comma, a bar or a semicolon.
        self.told = np.array([f"{k}{mark}" for mark in ",|;" for k in range(len(tokens))], dtype=object)


def _ranks(file: str, tokens: list[bytes]) -> dict[bytes, int] | None:
    """Tokens and ids as ranks, if that is all there is to the file: plain byte-level merges in the order of their ids."""
    with open(file, encoding="utf-8") as lines:
        told = json.load(lines)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and told["normalizer"] is None and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]] if plain else []
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    if not plain or ids != list(range(256, 256 + len(ids))):
        return None
    return {t: k for k, t in enumerate(tokens[:256 + len(ids)])}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def _byte_level(file: str) -> _Side:
    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    alphabet, vocabulary = _byte_alphabet(), tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        tokens[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    ranks = _ranks(file, tokens)
    quick = ranks and tiktoken.Encoding("local", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        # Long texts are encoded by pieces that no token spans.
        pieces = [list(split_safely(" " + t, PIECE_CHARS)) for t in texts]
        flat = [p for ps in pieces for p in ps]
        # Both libraries have the same merges. Only letters that every Unicode version classes
        # alike are left to the quicker one.
        own = [k for k, p in enumerate(flat) if not (quick and _latin(p))]
        found: list = [None] * len(flat)
        for k, ids in zip(own, tokenizer.encode_batch_fast([flat[k] for k in own], add_special_tokens=False)):
            found[k] = ids.ids
        each = iter(quick.encode_to_numpy(p, disallowed_special=()) if f is None else f for p, f in zip(flat, found))
        return [np.concatenate([next(each) for _ in ps]) if len(ps) > 1 else next(each) for ps in pieces]

    return _Side(tokens, encode)


@functools.lru_cache(maxsize=2)
def _pieces(file: str) -> _Side:
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    tokens = [
        bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace(SPACE, " ").encode() for k, name in enumerate(names)]
    # If no piece has a space behind something else, a text may be cut there: the
    # model puts a space in front of the rest, which stands for the one cut off.
    cuttable = not any(name.lstrip(SPACE).count(SPACE) for name in names)

    def encode(texts: list[str]) -> list[list[int]]:
        pieces = [list(split_safely(t, PIECE_CHARS, _AT_SPACE)) if cuttable else [t] for t in texts]
        found = iter(model.encode([p[1:] if k else p for ps in pieces for k, p in enumerate(ps)], num_threads=1))
        return [[k for _ in ps for k in next(found)] if len(ps) > 1 else next(found) for ps in pieces]

    return _Side(tokens, encode)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists of byte ends with an equal last one: the group of each token, and the links as indices.

    A group's links are its tokens in step: each stretch between neighbouring ends lies in one token of either side.
    """
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    index_a, index_b = dict(zip(list_a, range(len(list_a)))), dict(zip(list_b, range(len(list_b))))
    common = sorted(index_a.keys() & index_b.keys())
    cut_a, cut_b = (np.array([*itemgetter(*common, common[-1])(index)][:-1]) for index in (index_a, index_b))
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(common)), size_a), np.repeat(np.arange(len(common)), size_b)
    # A slice of m and n tokens has m + n - 1 stretches, as only its last end is shared.
    at_a, at_b = np.zeros(list_a[-1] + 1, np.int8), np.zeros(list_a[-1] + 1, np.int8)
    at_a[ends_a] = at_b[ends_b] = 1
    stretches = np.flatnonzero(at_a | at_b)
    before_a, before_b = (np.cumsum(at, dtype=np.int32)[stretches] - at[stretches] for at in (at_a, at_b))
    return group_a, group_b, before_a, before_b


def _told(one: _Side, two: _Side, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides, group by group."""
    n_a, n_b = len(one.bytes), len(two.bytes)
    ends_a, ends_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    out[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = one.told[ids_a + n_a * ends_a]
    out[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = two.told[ids_b + 2 * n_b * ends_b]
    return "".join(out.tolist())[:-1]


_NOTHING = (0, 0, 0, 0, "", b"")


def _aligned(one: _Side, two: _Side, text: bytes, a, b, squeeze) -> tuple:
    ids_a, ids_b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    if b"".join(one.bytes[ids_a].tolist()) != text or b"".join(two.bytes[ids_b].tolist()) != text:
        return _NOTHING
    group_a, group_b, at_a, at_b = align(np.cumsum(one.sizes[ids_a]), np.cumsum(two.sizes[ids_b]))
    told = hashlib.sha256(_told(one, two, ids_a, ids_b, group_a, group_b).encode()).hexdigest()
    pairs, times = np.unique(ids_a[at_a] << 32 | ids_b[at_b], return_counts=True)
    return len(a), len(b), int(group_a[-1]) + 1, len(at_a), told, _packed(pairs, times, squeeze)


def _packed(pairs: np.ndarray, times: np.ndarray, squeeze) -> bytes:
    """Sorted pairs of ids and how often each is linked, compressed: a's first, as steps, then b's and times."""
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    columns = np.concatenate([np.diff(a, prepend=0), b, times]).astype("<u4")
    # Byte by byte, so that high bytes, which are mostly zero, cost next to nothing.
    return squeeze(columns.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(value: bytes, expand) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(expand(value), np.uint8).reshape(4, -1).T
    columns = np.ascontiguousarray(raw).view("<u4").ravel().astype(np.int64).reshape(3, -1)
    return np.cumsum(columns[0]) << 32 | columns[1], columns[2]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ADDED = (*_COUNTS, "groups_sha256", "n_best", "count_sum")


def groups_and_links(docs: DataFrame, byte_level_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """All columns but ``text``, with ``n_a, n_b, n_groups, n_links, groups_sha256`` and the packed ``links``."""
    kept = [c for c in docs.columns if c not in (text, *_ADDED, "links")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in _COUNTS] + [
        T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])

    def run(stream):
        one, two = _byte_level(byte_level_file), _pieces(piece_file)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(stream, rows=1024, size=1 << 20):
            rows = [_NOTHING] * batch.num_rows
            texts = batch.column(text).to_pylist()
            at = [k for k, t in enumerate(texts) if t]
            some = [texts[k] for k in at]
            for k, t, a, b in zip(at, some, one.encode(some), two.encode(some)):
                rows[k] = _aligned(one, two, b" " + t.encode(), a, b, squeeze)
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(c, pa.int64()) for c in columns[:4]],
                 pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())],
                names=[*kept, *_COUNTS, "groups_sha256", "links"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (a's id in the high half, b's in the low), ``n`` documents that hold it linked, and ``best``: no pair of a's has more.

    Tasks add up their own documents first; an id of a has no more pairs than b has ids.
    """
    def run(stream):
        expand = zstandard.ZstdDecompressor().decompress
        held, n_held = [], 0
        for batch in sliced(stream):
            values = [_unpacked(v, expand)[0] for v in batch.column("links").to_pylist() if v]
            if values:
                held.append(np.unique(np.concatenate(values), return_counts=True))
                n_held += len(held[-1][0])
            if n_held > 4 * _BLOCK:
                held = [_added(held)]
                n_held = len(held[0][0])
                if n_held > 2 * _BLOCK:
                    yield from _blocks(*held[0])
                    held, n_held = [], 0
        if held:
            yield from _blocks(*_added(held))

    counted = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "pairs")
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)


def _blocks(pairs: np.ndarray, n: np.ndarray):
    for k in range(0, len(pairs), _BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[k:k + _BLOCK]), pa.array(n[k:k + _BLOCK])], names=["pair", "n"])


def _with_arrays(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Looked up in sorted arrays that every task has."""
    table = counts.toArrow().sort_by("pair")
    spark = aligned.sparkSession
    sent = spark.sparkContext.broadcast((
        table["pair"].to_numpy(), table["n"].to_numpy() * 2 + table["best"].to_numpy().astype(np.int64)))
    kept = [c for c in aligned.columns if c != "links"]
    schema = T.StructType([aligned.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def run(stream):
        expand, (pairs, n) = zstandard.ZstdDecompressor().decompress, sent.value
        for batch in sliced(stream):
            best, total = [], []
            for value in batch.column("links").to_pylist():
                if not value:
                    best.append(0)
                    total.append(0)
                    continue
                mine, times = _unpacked(value, expand)
                found = n[np.searchsorted(pairs, mine)]
                best.append(int(((found & 1) * times).sum()))
                total.append(int(((found >> 1) * times).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                names=[*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def _with_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Joined by pair, whatever the number of pairs; Spark splits the partitions of frequent ones."""
    def run(stream):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in sliced(stream, rows=64):
            rows, pairs, times = [], [], []
            for row, value in zip(batch.column(ROW).to_pylist(), batch.column("links").to_pylist()):
                if value:
                    mine, n = _unpacked(value, expand)
                    rows.append(np.full(len(mine), row))
                    pairs.append(mine)
                    times.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, pairs, times)], names=[ROW, "pair", "times"])

    links = aligned.select(ROW, "links").mapInArrow(run, f"{ROW} bigint, pair bigint, times bigint")
    summed = links.join(counts.hint("merge"), "pair").groupBy(ROW).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    kept = [c for c in aligned.columns if c != "links"]
    return aligned.select(*kept).join(summed, ROW, "left").select(
        *kept, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")])


def cross_align(docs: DataFrame, byte_level_file: str, piece_file: str, text: str = "text",
                most_pairs: int = MOST_PAIRS) -> DataFrame:
    """All columns but ``text``, with ``n_a, n_b, n_groups, n_links, groups_sha256, n_best`` and ``count_sum``.

    A space and the text are encoded by the byte-level vocabulary (a), the text by the
    piece model (b), which puts the space there itself; strings of special tokens are plain
    text. ``n_best`` counts the links whose pair of ids is linked in as many documents as any
    pair of that a id, ``count_sum`` adds up those document counts over all links.

    Null and empty texts, and texts that the tokens of either side do not give back byte
    by byte, have no tokens: zeros, and '' for the digest. Repeated rows and ids are documents of
    their own. Added columns replace ones of their name. Counts of up to ``most_pairs`` pairs go to all tasks;
    more are joined, with the same results. Both files must be readable by every executor.
    """
    aligned = materialise(with_row(groups_and_links(docs, byte_level_file, piece_file, text)), "aligned")
    counts = materialise(pair_counts(aligned), "counts")
    held = _with_arrays if counts.count() <= most_pairs else _with_join
    return held(aligned, counts).drop(ROW)
