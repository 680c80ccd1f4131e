"""The pipeline and its stages against brute force."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from bibflow.llm import quality
from bibflow.llm.shipping import ship
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_query


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    return docs, items


def test_rows_equal_brute_force(spark, sf_dir, tables):
    docs, items = tables
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ship(spark)
    model = quality.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=corpus_pipeline.LABELLED_ROWS)
    good = {r.doc_id for r in quality.score(source, model).where("score >= 0.3").select("doc_id").collect()}
    assert len(good) < len(docs)
    kept = [dict(d) for d in docs if d["doc_id"] in good]

    for name in {d["source"] for d in kept}:
        mine = [d for d in kept if d["source"] == name]
        count = {}
        for d in mine:
            for line in {x.strip(" \t\r") for x in d["text"].split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        gone = {line for line, n in count.items() if n >= 10 and n > 0.05 * len(mine)}
        for d in mine:
            lines = d["text"].split("\n")
            left = [x for x in lines if x.strip(" \t\r") not in gone]
            if len(left) < len(lines):
                d["text"] = "\n".join(left)
                d["n_chars"] = len(d["text"])

    groups = brute_query([(d["doc_id"], d["text"]) for d in kept], shingle=4)
    kept = [d for d in kept if groups[d["doc_id"]][1] == d["doc_id"]]
    bad = {r[0] for r in brute_contamination([(d["doc_id"], d["text"]) for d in kept], items) if r[5]}
    kept = [d for d in kept if d["doc_id"] not in bad]

    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {d["doc_id"]: (*(d[c] for c in ("text", "lang", "source", "n_chars")), encoding.encode_ordinary(d["text"])) for d in kept}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.intact and r.n_tokens == len(r.ids) // 4 for r in found)
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars, np.frombuffer(r.ids, "<u4").tolist()) for r in found} == expected
    assert len(found) == len(expected)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1, 2), (1, "", "en", "a", 0, 1, 2), (2, "word " * 30_000, "en", None, 5, 1, 2),
         (2, "word " * 30_000, "en", None, 5, 1, 2), (3, "A short note on it.", "en", "a", 19, 1, 2)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, n_dropped int")
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
        assert all(r.intact for r in last)
        assert not (empty and last)


def test_a_group_of_copies_keeps_its_text(spark, sf_dir):
    """Two groups of copies, each a third of a source or more, leave one whole document each."""
    texts = ["A river bends\nnear the old mill\nand slows down.", "Bread is baked\nbefore the sun\nhas risen here."]
    rows = [(k, texts[k % 2], "en", "a", 50) for k in range(40)] + [
        (100 + k, f"Own text {k} of nobody else\nMenu", "en", "a", 30) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf_dir).collect()}
    assert len(lines) == 60
    assert all(lines[k] == texts[k % 2] for k in range(40))
    assert all("Menu" not in lines[100 + k] for k in range(20))
    again = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in lines.items()], docs.schema)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_copy_stage(spark, again, sf_dir).collect()}
    assert kept[0] == texts[0] and kept[1] == texts[1] and not set(range(2, 40)) & set(kept)
