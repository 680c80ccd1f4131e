"""Shared pieces of the word-based operators: row keys, word splitting, hashing, Bloom filters.

Texts are handled as UTF-8 bytes in Arrow batches; nothing here holds more than
one batch and one document at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.runtime import materialise

ROW = "_llm_row"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def with_row(docs: DataFrame) -> DataFrame:
    """Give every row a number of its own.

    The number follows from a row's place in the input, so ``docs`` should be a
    stored table: it has the same numbers each time it is read.
    """
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with row numbers, written to the shared folder.

    How files are packed into partitions, and so the number of a row, follows the
    cores that are there when a scan is planned. Where decisions about rows are
    joined to the rows again, all steps have to read numbers that are written down.
    """
    return materialise(with_row(docs), "numbered")


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged."""
    return (text or b"").split()


def lower_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return (text or b"").translate(_LOWER).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_ALNUM).split()


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _widths(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes of text and lists each row has."""
    widths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            widths += 8 * pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            widths += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return widths


def sliced(stream: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of one stays small: ``rows`` rows and about ``size`` bytes at most.

    A single row of more bytes is a batch of its own.
    """
    for batch in stream:
        ends, start = np.cumsum(_widths(batch)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function out of one for a single small batch."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out
    return run


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes of all runs of ``width`` words, modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        powers = np.full(size, self.base, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        back = np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.inverse = np.cumprod(back, dtype=np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums, from which ``of`` takes any width."""
        n = len(hashes)
        if n >= len(self.powers):
            self._grow(1 << (n + 1).bit_length())
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:n], dtype=np.uint64)])

    def of(self, sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        value = (sums[starts + width] - sums[starts]) * self.inverse[starts]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


class Bloom:
    """A set of 64-bit keys as bits; it may hold more than was put in, never less.

    At most ``2**most_bits`` bits (32 MB), whatever the number of keys. Beyond
    about 16 million keys it filters less, so an exact join must follow.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, keys: DataFrame, column: str, most_bits: int = 28) -> Bloom:
        count = max(1, keys.count())
        bits = min(most_bits, max(16, (16 * count - 1).bit_length()))
        key = F.col(column)
        places = F.explode(F.array(*[F.shiftrightunsigned(key, s) for s in (0, 17, 36)])).alias("p")
        places = keys.select(places).select(F.col("p").bitwiseAND((1 << bits) - 1).alias("p"))
        set_bits = places.groupBy(F.shiftright("p", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
        ).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def __contains__(self, keys: np.ndarray) -> bool:
        return bool(self.has(np.asarray(keys, np.uint64)).all())

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For an array of keys, which may be in the set."""
        found = np.ones(len(keys), bool)
        for shift in (0, 17, 36):
            place = (keys >> np.uint64(shift)) & self.mask
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found
