"""Rules and perplexities against dictionaries of plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from bibflow.llm import perplexity, queries
from bibflow.llm.words import _LOWER


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k:k + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def half_of(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value >> 20 & 1


def grams(text, order):
    data = bytes(order - 1) + text.encode().translate(_LOWER)
    return [data[k:k + order] for k in range(len(data) - order + 1)]


def model(texts, order):
    """Probability of a run's last byte by modified Kneser-Ney over these texts."""
    counts = {order: Counter(g for t in texts for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, contexts = {}, {}
    for k, level in counts.items():
        m = Counter(level.values())
        if all(m[i] for i in (1, 2, 3, 4)):
            y = m[1] / (m[1] + 2 * m[2])
            off[k] = [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            off[k] = [0.5] * 3
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, n in level.items():
            contexts[k][g[:-1]][0] += n
            contexts[k][g[:-1]][1] += off[k][min(n, 3) - 1]
    def p(run):
        k = len(run)
        if not k:
            return 1 / 256
        lower = p(run[1:])
        if run[:-1] not in contexts[k]:
            return lower
        total, free = contexts[k][run[:-1]]
        n = counts[k].get(run, 0)
        return ((n - off[k][min(n, 3) - 1] if n else 0) + free * lower) / total
    return p


def brute(rows, order, lower=perplexity.LOWER, upper=perplexity.UPPER):
    texts = {t for _, t, _ in rows if t}
    models = [model([t for t in texts if half_of(t) == 1 - h], order) for h in (0, 1)]
    known = {}
    scored = []
    for key, text, lang in rows:
        bits = None
        if text:
            if text not in known:
                p = models[half_of(text)]
                known[text] = -sum(math.log2(p(g)) for g in grams(text, order)) / len(text.encode())
            bits = known[text]
        scored.append((key, text, lang, bits))

    def median(values):
        values = sorted(values)
        return values[(len(values) + 1) // 2 - 1]

    out = {}
    for lang in {r[2] for r in rows}:
        steps = [round(b * 256) for *_, x, b in scored if x == lang and b is not None]
        if steps:
            middle = median(steps)
            scale = 1.4826 * max(1, median([abs(s - middle) for s in steps]))
            out[lang] = (middle - lower * scale) / 256, (middle + upper * scale) / 256
    for key, text, lang, bits in scored:
        s = stats(text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        low, high = out.get(lang, (0, 0))
        yield key, s, bits, failed, not failed and low <= bits <= high


def _judged(df, **kind):
    names = (*perplexity._STATS, "bits_per_byte", "base_failed", "kept")
    return {r.doc_id: tuple(r[c] for c in names) for r in perplexity.judge(df, **kind).collect()}


def _same(found, rows, order, **kind):
    expected = {k: (*s, bits, failed, kept) for k, s, bits, failed, kept in brute(rows, order, **kind)}
    assert set(found) == set(expected)
    for k, row in expected.items():
        assert found[k][:5] == row[:5] and found[k][6:] == row[6:], k
        assert (found[k][5] is None) == (row[5] is None) and (row[5] is None or math.isclose(found[k][5], row[5], rel_tol=1e-5)), k


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_query_equals_brute_force(spark, sf_dir, documents):
    found = queries.QUERIES["op11_quality_rules"](spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", **dict.fromkeys(perplexity._STATS, "bigint"), "base_failed": "boolean", "kept": "boolean"}
    expected = {(k, *s, failed, kept) for k, s, _, failed, kept in brute(documents, perplexity.ORDER)}
    assert {tuple(r) for r in found.collect()} == expected


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one two three one two three", "en"), (5, "a\n\na\n a\nb #*$%&|<>", "xx"),
    (6, "é中 \U0001f600 \u0000 nul space", None), (7, "same text here", "en"), (8, "same text here", "de"), (9, "x" * 5000, "en"),
    (10, " ".join(f"w{k}" for k in range(80)), "en"), (11, " ".join(f"w{k % 7}" for k in range(80)), "en"),
]


@pytest.mark.parametrize("most_runs", [perplexity.MOST_RUNS, 0])
@pytest.mark.parametrize("order", [1, 3, 6])
def test_odd_rows(spark, order, most_runs, monkeypatch):
    """The same rows whether probabilities are looked up or joined, and wherever long texts are cut."""
    monkeypatch.setattr(perplexity, "_CHUNK", 37)
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").repartition(3)
    _same(_judged(df, order=order, most_runs=most_runs, lower=2.0, upper=2.0), ODD, order, lower=2.0, upper=2.0)


def test_unusual_texts_go(spark, documents, sf_dir):
    """Strange letters are above their language's range in either half; documents of good quality are within it."""
    usual = [r for r in documents if r[1]]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    strange = [(10_000 + k, " ".join(f"{(k * 7919 + j) * 104729 % 999983:x}#{j * j:o}" for j in range(90)), "en") for k in range(6)]
    rows = usual + strange
    found = _judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert not any(found[k][7] for k, *_ in strange)
    clean = [k for k, *_ in usual if not found[k][6] and k in good]
    assert len(clean) > 30 and [k for k in clean if not found[k][7]] == []


def test_copies_count_once(spark):
    """A text's copies neither make it likely nor change what others score."""
    rows = [(k, f"text number {k} says {k * k}", "en") for k in range(40)]
    many = rows + [(100 + k, rows[0][1], "en") for k in range(300)]
    columns = "doc_id bigint, text string, lang string"
    one, two = (_judged(spark.createDataFrame(x, columns).repartition(4)) for x in (rows, many))
    assert all(math.isclose(one[k][5], two[k][5]) for k, *_ in rows)
    assert {round(two[100 + k][5], 9) for k in range(300)} == {round(one[0][5], 9)}


def test_empty_table_and_clashing_columns(spark):
    assert perplexity.judge(spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "en", "x", 5, "r")], "doc_id bigint, text string, lang string, run string, n_words int, half string")
    out = perplexity.judge(df).collect()
    assert (out[0].run, out[0].half, out[0].n_words, out[0].kept) == ("x", "r", 2, False)


def test_few_runs_are_shuffled_per_context(spark):
    with pytest.raises(ValueError):
        perplexity.run_counts(spark.range(1).select(F.lit(1).alias("_llm_hash"), F.lit("x").alias("text")), order=7)
