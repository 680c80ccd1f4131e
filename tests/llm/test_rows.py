"""Row numbers when files are packed otherwise from one job to the next, as when cores come or go."""

import pytest

from bibflow.llm import decontaminate, simhash, substrings, words
from tests.llm.test_substrings import brute

MODULES = (decontaminate, simhash, substrings, words)


@pytest.fixture
def repacked(spark, tmp_path, monkeypatch):
    """Stored documents; after an operator wrote what it decides by, their files make one partition."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage if k % 3 == 0 else ''} " + " ".join(f"w{k}x{j}" for j in range(20 + 9 * k))) for k in range(24)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id").write.parquet(path)

    for module in MODULES:
        if hasattr(module, "materialise"):
            def once(df, label, write=module.materialise):
                out = write(df, label)
                if label in ("fingerprints", "occurrences", "repeats"):
                    spark.conf.set("spark.sql.files.minPartitionNum", "1")
                return out
            monkeypatch.setattr(module, "materialise", once)
    yield rows, spark.read.parquet(path)
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_substrings(repacked):
    rows, docs = repacked
    found = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found) == [r[:3] for r in sorted(brute(rows))]


def test_near_copies(repacked):
    rows, docs = repacked
    twice = docs.unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "text"))
    kept = simhash.drop_near_duplicates(twice).collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in rows]


def test_benchmark(spark, repacked):
    rows, docs = repacked
    items = spark.createDataFrame([(1, rows[4][1]), (2, rows[7][1])], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in rows if r[0] not in (4, 7)]
