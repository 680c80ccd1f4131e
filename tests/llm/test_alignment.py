"""Alignment against a plain one, token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bibflow.llm import alignment, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    """The ids and bytes of both sides, from the libraries as they are."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    alphabet = alignment._byte_alphabet()
    one = a.encode(" " + text, add_special_tokens=False)
    two = b.encode(text)
    names = [b.id_to_piece(k) for k in two]
    return (one.ids, [bytes(alphabet[c] for c in t) for t in one.tokens],
            two, [bytes([int(n[3:-1], 16)]) if b.is_byte(k) else n.replace("▁", " ").encode() for k, n in zip(two, names)])


def plain(text):
    """(ids of a, ids of b, groups as text, links as pairs of ids) by intervals compared one with another."""
    if not text:
        return [], [], "", []
    a, bytes_a, b, bytes_b = tokens(text)
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], "", []
    spans = []
    for parts in (bytes_a, bytes_b):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    links = []
    start = 0
    for i, (low, high) in enumerate(spans[0]):
        while spans[1][start][1] <= low:
            start += 1
        j = start
        while j < len(b) and spans[1][j][0] < high:
            links.append((a[i], b[j]))
            j += 1
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    told, low = [], 0
    for high in cuts:
        told.append("|".join(",".join(str(k) for k, (s, e) in zip(ids, side) if low <= s and e <= high)
                             for ids, side in zip((a, b), spans)) if len(cuts) < 400 else None)
        low = high
    if len(cuts) >= 400:  # the same, without a pass over all tokens per group
        told, at = [], [0, 0]
        for high in cuts:
            part = []
            for k, ids in enumerate((a, b)):
                first = at[k]
                while at[k] < len(ids) and spans[k][at[k]][1] <= high:
                    at[k] += 1
                part.append(",".join(map(str, ids[first:at[k]])))
            told.append("|".join(part))
    return a, b, ";".join(told), links


def brute(rows):
    found = [(k, *plain(text)) for k, text in rows]
    count = Counter(pair for *_, links in found for pair in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return sorted((k, len(a), len(b), told.count(";") + 1 if a else 0, len(links), sum(count[x] == best[x[0]] for x in links),
                   sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else "")
                  for k, a, b, told, links in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.integers(0, 2 ** 31))
def test_links_are_overlaps(sizes, seed):
    total, rng = sum(sizes), np.random.default_rng(seed)
    ends_a = np.cumsum(sizes)
    ends_b = np.append(np.flatnonzero(rng.random(total - 1) < 0.4) + 1, total)
    group_a, group_b, i, j = alignment.align(ends_a, ends_b)
    low_a, low_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    expected = [(x, y) for x in range(len(ends_a)) for y in range(len(ends_b))
                if low_a[x] < ends_b[y] and low_b[y] < ends_a[x]]
    assert list(zip(i.tolist(), j.tolist())) == expected
    common = sorted(set(ends_a) & set(ends_b))
    assert group_a.tolist() == [sum(c < e for c in common) for e in ends_a]
    assert group_b.tolist() == [sum(c < e for c in common) for e in ends_b]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op13_alignment"](spark, sf_dir)
    assert {t for c, t in found.dtypes if c != "groups_sha256"} == {"bigint"}
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "▁ is a space here"), (7, "▁"),
    (8, "tab\tand\nline\r\n  double  spaces   "), (9, "é中文 \U0001f600‍ \u0000 nul"), (10, "café ﬁ Å"),
    (11, "same text"), (11, "same text"), (None, "same text"), (12, "x" * 3000), (13, " leading"), (14, "\n"),
]


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_odd_rows(spark, most_pairs):
    """The same rows whether counts are looked up or joined."""
    rows = [(k if k is not None else -1, t) for k, t in ODD]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = alignment.cross_align(df, *FILES, most_pairs=most_pairs)
    found = sorted(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in out.collect())
    assert found == brute(rows)


def test_both_libraries_give_the_same_ids():
    """Every pair of characters that the quicker one may get, after letters, digits, marks and spaces."""
    side = alignment._byte_level(FILES[0])
    tokenizer = Tokenizer.from_file(FILES[0])
    tokenizer.encode_special_tokens = True
    texts = ["".join(f"a{chr(x)}{chr(y)} {chr(x)}{chr(y)}1{chr(x)}.{chr(y)}\n" for y in range(256)) for x in range(256)]
    assert all(alignment._latin(t) for t in texts)
    assert [list(ids) for ids in side.encode(texts)] == [
        e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_long_text_by_pieces(spark, monkeypatch):
    words = ["alpha", "b", "Café!", "42nd", "x-y", "\n", "", "tail's", "▁"]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(words[i] for i in rng.integers(0, 8 + k % 2, 4000))) for k in range(4)]
    monkeypatch.setattr(alignment, "PIECE_CHARS", 50)
    for side, whole in ((alignment._byte_level(FILES[0]), 0), (alignment._pieces(FILES[1]), 2)):
        assert [list(x) for x in side.encode([t for _, t in rows])] == [tokens(t)[whole] for _, t in rows]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.cross_align(empty, *FILES).collect() == []
    df = spark.createDataFrame([(1, "two words", "x", "y", 5)], "doc_id bigint, text string, links string, pair string, n_a int")
    out = alignment.cross_align(df, *FILES).collect()
    assert out[0].pair == "y" and out[0].n_a == 2 and out[0].n_links == out[0].n_best == out[0].count_sum == 2
