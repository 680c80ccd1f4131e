"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from bibflow.llm import ann
from bibflow.llm.queries import QUERIES
from bibflow.llm.shipping import ship


def brute(rows, k, asks):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero([asks(i) for i in ids]):
        score = (x * x[q]).sum(axis=1)
        order = [o for o in np.lexsort((ids, -score)) if ids[o] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[o]), float(score[o])) for o in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(found, expected):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(len(e) for e in expected.values())


def test_query_recall_and_scores(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected, found = brute(rows, 20, lambda i: i % 20 == 0), results(QUERIES["op2_ann"](spark, sf_dir))
    assert found.keys() == expected.keys()
    assert recall(found, expected) >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    for q, near in found.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0])) and len(near) == 20
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-12 for i, s in near)


def test_clusters_need_few_parts():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((16, 1, 24)) * 3 + rng.standard_normal((16, 100, 24)) * 0.3).reshape(-1, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann.balanced_parts(ann.neighbour_graph(x, 10), 16)
    assert np.bincount(part).tolist() == [100] * 16
    router = ann.fit_router(x, 16)
    assert router.parts == 16 and router.probes <= 4


def test_many_parts_blocks_and_copies(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((900, 8)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, (20 * x[0]).tolist()) for i in range(300)] + [(2000, x[1].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = results(ann.search(df, F.col("vec_id") % 20 == 0, k=5, part_rows=64, block_rows=16, recall=1.0))
    expected = brute(rows, 5, lambda i: i % 20 == 0)
    assert found.keys() == expected.keys()
    assert recall(found, expected) >= 0.97
    copies = found[1000]
    assert [i for i, _ in copies[:5]] == [1001, 1002, 1003, 1004, 1005] and len({s for _, s in copies}) == 1


def test_odd_rows(spark):
    ship(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 2.0]), (None, [1.0, 1.0]),
            (20, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (40, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, part string")
    assert results(ann.search(df, F.col("vec_id") % 20 == 0)) == brute(rows, 20, lambda i: i % 20 == 0)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_one_ragged_row_takes_no_part(spark):
    """Whichever row is of another length, the others are searched."""
    ship(spark)
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((21, 3)))]
    for odd in range(1, 20, 3):
        some = [(i, v[:2] if i == odd else v) for i, v in rows]
        df = spark.createDataFrame(some, "vec_id bigint, embedding array<double>")
        found = results(ann.search(df, F.col("vec_id") % 20 == 0, k=4))
        assert found.keys() == {0, 20}
        expected = brute([r for r in some if r[0] != odd], 4, lambda i: i % 20 == 0)
        assert {q: [i for i, _ in near] for q, near in found.items()} == {q: [i for i, _ in near] for q, near in expected.items()}


def test_probes_hold_for_rows_not_trained_on():
    """The router of a sample, used on other rows, finds about the share of neighbours that it was fitted for."""
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((40, 16)) * 2
    draw = lambda n: middle[rng.integers(0, 40, n)] + rng.standard_normal((n, 16))
    router, rows = ann.fit_router(draw(2000), 16), draw(3000)
    assert router.parts == 16 and router.probes < 16
    filed = router.likeliest(rows, 1)[:, 0]
    looked = router.likeliest(rows, router.probes)
    graph = ann.neighbour_graph(rows, 20)
    assert (filed[graph][:, :, None] == looked[:, None, :]).any(axis=2).mean() >= 0.92
