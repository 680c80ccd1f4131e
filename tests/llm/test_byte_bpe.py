"""Byte-level BPE against the library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from bibflow.llm import byte_bpe
from bibflow.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, sf_dir):
    whole, sha = encoding(), lambda b: hashlib.sha256(b).hexdigest()
    expected = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = whole.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert set(map(tuple, QUERIES["op8_byte_bpe"](spark, sf_dir).collect())) == expected


PIECES = ["a", "Word", " ", "  ", "\n", "\t\n ", "'s", "'", "12", "3.5", "é", "́", "漢字", "。", "\x1c", "\x85", " ", "!?", "-", "🙂", "<|endoftext|>"]


def test_every_cut_keeps_the_ids():
    rng, whole = random.Random(4), encoding()
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))
        for size in (1, 2, 7):
            parts = list(byte_bpe.split_safely(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text), text


def test_odd_rows(spark):
    texts = [None, "", " ", "<|endoftext|>", "no spaces " * 30_000, "x" * 3000, "é́ \U0001f642\n\n"]
    df = spark.createDataFrame([(1, t, "c", "d") for t in texts + ["", ""]], "doc_id bigint, text string, ids string, decoded string")
    done = byte_bpe.decode(byte_bpe.encode(df, FILE, public_tokenizers.PATTERN, piece_chars=1000), FILE, public_tokenizers.PATTERN)
    assert set(done.columns) == set(df.columns)
    whole, rows = encoding(), done.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.decoded.decode() == (r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == whole.encode_ordinary(r.text or "")


def test_partial_characters_null_and_empty(spark):
    cut = np.array(encoding().encode_ordinary("\U0001f642")[:1], "<u4").tobytes()
    df = spark.createDataFrame([(cut,), (None,), (b"",)], "ids binary")
    found = [r.decoded for r in byte_bpe.decode(df, FILE, public_tokenizers.PATTERN).collect()]
    assert found[0] and "\U0001f642".encode().startswith(bytes(found[0]))
    assert found[1] is None and found[2] == b""
    assert byte_bpe.encode(spark.createDataFrame([], "text string"), FILE, public_tokenizers.PATTERN).collect() == []
