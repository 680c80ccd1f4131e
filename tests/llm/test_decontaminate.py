"""Decontamination against brute force."""

import hashlib
import re

from bibflow.llm import decontaminate
from bibflow.llm.queries import QUERIES, SQL
from tests.oracle import database, differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                held = windows.get(tuple(w[i:i + size]))
                if held:
                    hit.update(range(i, i + size))
                    found |= held
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def as_rows(df):
    from pyspark.sql import functions as F
    df = df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("s"), "contaminated")
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    df = QUERIES["op5_decontaminate"](spark, sf_dir)
    assert differences(df, database(sf_dir), SQL["op5_decontaminate"]) == []
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, df.collect()), key=repr) == brute(docs, items)
    assert df.where("n_hit > 0").count()


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Only Three words"), (3, ""), (4, None), (None, "one"), (5, "same same same same same same same"),
         (6, LONG), (7, "été déjà vu là-bas")]
DOCS = [(1, "x " * 50 + LONG + " y" * 300), (2, LONG.replace(" ", ",  ").upper()), (3, "only three, words! " * 3), (4, None), (5, ""),
        (6, "same " * 100), (7, "nothing here"), (7, "one more " + "z " * 19), (None, "l'ÉTÉ; été DÉJÀ-vu là bas ONE"), (8, " ".join(LONG.split()[:12])),
        (9, "q " * 100_000 + " ".join(LONG.split()[5:18]))]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in DOCS], "doc_id bigint, text string, n_words int, hash string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    judged = decontaminate.contamination(docs, items)
    assert as_rows(judged) == brute(DOCS, ITEMS)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in brute(DOCS, ITEMS))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert as_rows(decontaminate.contamination(docs, items.limit(0))) == brute(DOCS, [])
