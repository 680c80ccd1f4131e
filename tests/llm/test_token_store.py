"""Token store against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bibflow.llm import token_store
from bibflow.llm.queries import QUERIES
from bibflow.runtime import scratch_path

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute(docs):
    tokenizer, at, out = Tokenizer.from_file(FILE), 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_library(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_token_store"](spark, sf_dir).collect())) == brute(rows)


ODD = [(3, "It's 100% 0 o'clock 10\n\tRÉSUMÉ é ́x İstanbul ΣΑΣ"), (None, "first"), (1, None), (2, ""), (5, " \n "),
       (4, "a b c\x1cd \x85 <|endoftext|> <|startoftext|>x"), (6, "漢字 كلمة 1２٣ 𝟘 0"), (7, "word " * 120_000 + "z" * 5000)]


def test_odd_texts_and_single_documents(spark):
    rng = random.Random(1)
    docs = ODD + [(10 + k, " ".join(rng.choice(["ab", "Cd,", "0", "x0y", "don't", "é", "!?"]) for _ in range(k))) for k in range(40)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, start int")
    path = scratch_path(spark, "tokens")
    token_store.write_store(df, path, FILE, 1, shards=3)
    back = token_store.read_store(spark, path).collect()
    found = sorted(((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in back), key=lambda r: r[1])
    assert found == brute(docs)
    wanted = spark.createDataFrame([(3,), (7,), (99,), (None,)], "doc_id bigint")
    some = token_store.read_documents(spark, path, wanted).collect()
    whole = {r.doc_id: (r.start, r.ids) for r in back}
    assert {r.doc_id: (r.start, r.ids) for r in some} == {d: whole[d] for d in (3, 7)}


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "one"), (1, "one"), (1, "two three"), (0, "zero")], "doc_id bigint, text string")
    path = scratch_path(spark, "tokens")
    token_store.write_store(df, path, FILE, 1, shards=4)
    found = sorted((r.start, len(r.ids) // 4) for r in token_store.read_store(spark, path).collect())
    assert len(found) == 4
    assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))


def test_empty_table_and_damaged_dictionary(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    path = scratch_path(spark, "tokens")
    token_store.write_store(df, path, FILE, 1)
    assert token_store.read_store(spark, path).collect() == []
    spark.createDataFrame([("00", bytearray(b"x"))], "hash string, content binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="damaged"):
        token_store.read_store(spark, path)
