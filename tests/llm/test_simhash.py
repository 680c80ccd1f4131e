"""SimHash, the trie join and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from bibflow.llm import simhash
from bibflow.llm.components import connected_components
from bibflow.llm.queries import QUERIES


def brute_print(text, shingle):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [words] if len(words) < shingle else [words[i:i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_query(docs, shingle=4, budget=4):
    prints = {d: brute_print(t, shingle) for d, t in docs}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= budget]
    return {d: (f"{prints[d]:016x}", c) for d, c in brute_components(links, ids).items()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf_dir).collect()}
    assert found == brute_query([(r.doc_id, r.text) for r in rows])


def crowded(rng, n):
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    out = set(centres)
    for c in centres:
        for _ in range(12):
            out.add(c ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(7))}))
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("brute,most", [(1, 64), (256, 1 << 18)])
def test_labels_within_and_between(brute, most):
    values = crowded(random.Random(5), 400)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    expected = brute_components([tuple(p) for p in np.argwhere(near)], range(len(values)))
    labels = simhash.linked_labels(values, None, 4, brute=brute, most=most)
    assert labels.tolist() == [expected[i] for i in range(len(values))]
    left, right = values[::2], values[1::2]
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= 4
    expected = brute_components([(i, j + len(left)) for i, j in np.argwhere(near)], range(len(values)))
    labels = simhash.linked_labels(left, right, 4, brute=brute, most=most)
    assert labels.tolist() == [expected[i] for i in range(len(values))]


def test_trie_links_with_deep_crowded_and_sliced_nodes(spark):
    rng = random.Random(7)
    crowd = {0xABCD << 48 | rng.getrandbits(20) for _ in range(300)}
    values = np.array(sorted({*crowd, *crowded(rng, 300).tolist()}), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    links = simhash.trie_links(df, node_rows=16, most_depth=9)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    signed = values.view(np.int64).tolist()
    expected = brute_components([(signed[i], signed[j]) for i, j in np.argwhere(near)], signed)
    assert {v: roots.get(v, v) for v in signed} == expected


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    edges = list(zip(names[:150], names[1:151])) + [(names[200], names[k]) for k in range(201, 300)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = brute_components(edges, names)
    assert all(found.get(n, n) == expected[n] for n in names)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


ODD = [(None, "one two three four five", "x"), (1, None, "x"), (2, "", "y"), (3, " \t\n", None), (4, "Word", "x"), (5, "word", "x"),
       (6, "a " * 70_000 + "b", "x"), (7, "a " * 70_000 + "b", "x"), (7, "a " * 70_000 + "b", "x"), (8, "é É", "z")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, fingerprint string")
    found = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert len(found) == len(ODD)
    by_id = {d: (p, c) for d, p, c in found}
    assert [by_id[d] for d in (1, 2, 3)] == [(0, 1)] * 3
    assert by_id[5] == by_id[4] and by_id[5][1] == 4
    assert by_id[7][1] == 6 and by_id[0][1] is None
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []
