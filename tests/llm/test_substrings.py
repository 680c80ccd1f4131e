"""Substring dedup against brute force."""

import hashlib
import random

from bibflow.llm import substrings
from bibflow.llm.queries import QUERIES


def brute(docs, window=50):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, digest)."""
    first, split = {}, [(d, (t or "").encode().split()) for d, t in docs]
    for d, words in split:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, QUERIES["op6_substring_dedup"](spark, sf_dir).collect()), key=repr)
    assert found == brute(rows)
    assert any(r[2] for r in found)


def test_passages_of_every_offset_and_length(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(90)]
    docs = []
    for k in range(70):
        length = 48 + k % 6 if k < 40 else 90
        begin = rng.randrange(91 - length)
        docs.append((k, " ".join([word() for _ in range(k)] + passage[begin:begin + length] + [word() for _ in range(k % 5)])))
    docs += [(100, "same " * 200), (101, "same  \n" * 120), (102, None), (103, ""), (104, "é" * 3), (None, " ".join(passage)),
             (105, " ".join(passage + passage)), (50, " ".join(passage)), (50, " ".join(passage)), (106, "x " * 60_000)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id bigint, text string, starts string")
    cut = substrings.remove_repeats(df).collect()
    found = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in cut]
    assert sorted(found, key=repr) == brute(docs)


def test_cover_reaches_every_pair_of_offsets():
    places = set(substrings.COVER)
    for i in range(31):
        for j in range(31):
            assert any((i + k) % 31 in places and (j + k) % 31 in places for k in range(31))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
