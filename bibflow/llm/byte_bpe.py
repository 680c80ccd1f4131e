"""Byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local file that every executor has. A long text is cut at
places that no token can span, so that the library never sees more than a
piece of it, and the ids of the pieces are those of the whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bibflow.llm.words import sliced

_BATCH = 1 << 20  # bytes of text that a task holds as Python objects
# White space after anything else starts a match of its own, and so do punctuation after an ASCII
# letter and an ASCII letter after a digit. Only characters that all Unicode versions class alike.
_SAFE = regex.compile(r"(?<=[^\s])(?=[ \n\t])|(?<=[A-Za-z])(?=[!-/:-@0-9])|(?<=[0-9])(?=[A-Za-z])")


def split_safely(text: str, piece_chars: int, safe=_SAFE) -> Iterator[str]:
    """Cut ``text`` after at least ``piece_chars`` characters, at the next safe boundary."""
    start = 0
    while len(text) - start > piece_chars:
        cut = safe.search(text, start + piece_chars)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def _encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _with_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in kept] + [pa.array(values, pa.binary())], names=[*kept, name])


def _schema(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", to: str = "ids",
           piece_chars: int = 1 << 16, decoded: str | None = None) -> DataFrame:
    """Add the ids of ``text`` as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded by itself; the texts of special tokens
    are ordinary text. A null or empty text has no ids. All other columns pass
    through; one already named ``to`` is replaced. Rows need no key and may
    repeat. No shuffle: each row is encoded where it is read. With ``decoded``, a
    column of that name gets the bytes that the ids stand for, in the same pass.
    """
    def run(stream):
        encoding = _encoding(ranks_file, pattern)
        for batch in sliced(stream, size=_BATCH):
            encoded = []
            for value in batch.column(text).to_pylist():
                parts = split_safely(value or "", piece_chars)
                encoded.append(b"".join(np.array(encoding.encode_ordinary(p), "<u4").tobytes() for p in parts))
            batch = _with_column(batch, to, encoded)
            yield batch if decoded is None else _with_column(batch, decoded, _decoded(encoding, encoded))
    schema = _schema(docs, to)
    if decoded is not None:
        schema = T.StructType([f for f in schema if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _decoded(encoding: tiktoken.Encoding, values: list[bytes | None]) -> list[bytes | None]:
    return [None if v is None else encoding.decode_bytes(np.frombuffer(v, "<u4").tolist()) for v in values]


def decode(docs: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for, unchecked: ids may end within a character.

    Null ids give null. An id without a rank is an error of the input and raises.
    """
    def run(stream):
        encoding = _encoding(ranks_file, pattern)
        for batch in sliced(stream, size=_BATCH):
            yield _with_column(batch, to, _decoded(encoding, batch.column(ids).to_pylist()))
    return docs.mapInArrow(run, _schema(docs, to))
