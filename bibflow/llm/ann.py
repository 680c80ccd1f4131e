"""Nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into equal parts that
keep neighbours together, and a small classifier learns from a vector the parts
in which its neighbours lie. Every vector is filed under its likeliest part; a
query looks into its several likeliest parts and compares whole vectors there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.llm.words import batches
from bibflow.plans.skew import first_per_group
from bibflow.runtime import materialise


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its ``k`` rows of largest inner product, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        close = x[at:at + 512] @ x.T
        close[np.arange(len(close)), np.arange(at, at + len(close))] = -np.inf
        best = np.argpartition(-close, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-close, axis=1)[:, :k]
        out[at:at + 512] = best
    return out


def _halves(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Cut ``nodes`` into two halves across which few edges (a, b) go."""
    place = np.full(n, -1)
    place[nodes] = np.arange(len(nodes))
    own = (place[a] >= 0) & (place[b] >= 0)
    i, j = place[a[own]], place[b[own]]
    degree = np.bincount(i, minlength=len(nodes)) + 1.0
    root, v = np.sqrt(degree), rng.standard_normal(len(nodes))
    for _ in range(60):  # towards the second eigenvector of the normalised graph
        v -= root * (root @ v) / (root @ root)
        v = v + (np.bincount(i, v[j] / root[j], len(nodes)) + v / root) / root
        v /= np.linalg.norm(v)
    side = np.zeros(len(nodes), bool)
    side[np.argsort(v / root, kind="stable")[len(nodes) // 2:]] = True
    for _ in range(12):  # swap the nodes that would gain most on either side, as many from each
        across = np.bincount(i, side[i] != side[j], len(nodes))
        gain = 2 * across - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        worth = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum()) // 2
        if not worth:
            break
        side[left[:worth]], side[right[:worth]] = True, False
        if np.bincount(i, side[i] != side[j], len(nodes)).sum() >= across.sum():
            side[left[:worth]], side[right[:worth]] = False, True
            break
    return nodes[~side], nodes[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each node of the graph, by repeated halving; ``parts`` is a power of two."""
    n, k = graph.shape
    a = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    rng, groups = np.random.default_rng(seed), [np.arange(n)]
    while len(groups) < parts:
        groups = [half for nodes in groups for half in _halves(nodes, a, b, n, rng)]
    part = np.zeros(n, np.int64)
    for number, nodes in enumerate(groups):
        part[nodes] = number
    return part


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer, and the number of parts a query looks into."""

    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum((x / np.maximum(norm, 1e-300)) @ w1 + b1, 0) @ w2 + b2

    def likeliest(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :count]

    @property
    def parts(self) -> int:
        return len(self.layers[3])


def _train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, seed: int = 7):
    """Cross-entropy against the share of a row's neighbours in each part, by Adam."""
    rng = np.random.default_rng(seed)
    p = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
         rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    m, s, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * m[k] / (np.sqrt(s[k]) + 1e-8)
    return tuple(p)


def fit_router(x: np.ndarray, parts: int, near: int = 20, recall: float = 0.95, hidden: int = 64,
               epochs: int = 20) -> Router:
    """Learn parts from a sample, and how many a query must look into.

    A quarter of the sample is kept out of training. The number is the smallest with
    which its rows find ``recall`` of their ``near`` nearest rows in that quarter, all
    of them filed by the router as any row of the table will be; they lie further off than those
    in the whole table. In the worst case it is all parts, and the search is exact.
    """
    order = np.random.default_rng(7).permutation(len(x))
    held, x = x[order[:len(x) // 4]], x[order[len(x) // 4:]]
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if parts <= 1:
        zero = np.zeros((1, 1))
        return Router((np.zeros((x.shape[1] if len(x) else 1, 1)), np.zeros(1), zero, np.zeros(1)), 1)
    graph = neighbour_graph(x, near)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(len(x)), part] += graph.shape[1] / 2
    router = Router(_train(x, target / target.sum(axis=1, keepdims=True), hidden, epochs), parts)
    likely = router.likeliest(held, parts)
    rank = np.argsort(likely, axis=1)
    needed = np.sort(np.take_along_axis(rank, likely[:, 0][neighbour_graph(held, near)], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Router(router.layers, probes)


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           sample_rows: int = 4096, part_rows: int = 1024, most_parts: int = 256, block_rows: int = 4096,
           recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of largest inner product found.

    Candidates are all rows but those with the query's id; ties go to the smaller
    id. Vectors that are null, all zero or hold a null or non-finite component,
    or whose length is not the one that most have (the larger of equals), take no part, and neither
    do rows without an id; rows repeated in full count once.

    The router is fitted on ``sample_rows`` rows at most, those with the smallest
    hash of their id. Every row is indexed. Equal vectors are one entry of the
    index with their ``k + 1`` smallest ids, more of which no query can return,
    and one search. Parts are cut into blocks of about ``block_rows``, so no task
    holds a whole part, and a part that is larger than others has more blocks.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = base.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width, total = (lengths["width"], lengths["count"]) if lengths else (0, 0)
    base = base.where(F.size("vector") == width)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).select("vector").toArrow()["vector"]
    x = np.unique(np.array(sample.to_pylist(), np.float64).reshape(-1, max(1, width)), axis=0)
    parts = 1
    while parts < most_parts and parts * part_rows < total:
        parts *= 2
    shared = spark.sparkContext.broadcast(fit_router(x, parts, recall=recall))

    ids = first_per_group(base.select("vector", "vec_id").distinct(), ["vector"], [F.col("vec_id")], k + 1)
    entries = ids.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = base.where("asks").select("vector", "vec_id").distinct()
    queries = materialise(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "queries")

    def route(count):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            router = shared.value
            found = router.likeliest(_matrix(batch.column("vector")), router.probes if count is None else count)
            lists = pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "parts"])
        return batches(run)

    kinds = {f.name: f.dataType.simpleString() for f in entries.schema} | {"query": queries.schema["query"].dataType.simpleString()}
    filed = entries.mapInArrow(route(1), f"vector {kinds['vector']}, ids {kinds['ids']}, parts array<int>").select(
        "vector", "ids", F.col("parts")[0].alias("part"))
    filed = materialise(filed, "entries")
    sent = queries.mapInArrow(route(None), f"vector {kinds['vector']}, query {kinds['query']}, parts array<int>").select(
        "vector", "query", F.explode("parts").alias("part"))

    def packed(df: DataFrame, block: str, name: str, size: int, *columns: str) -> DataFrame:
        """Blocks of at most about ``size`` rows of a part, each as one array. The sizes are a row per part."""
        blocks = F.broadcast(df.groupBy("part").agg(F.ceil(F.count("*") / size).alias("_blocks")))
        mine = F.pmod(F.xxhash64("vector"), F.col("_blocks")).alias(block)
        return df.join(blocks, "part").groupBy("part", mine).agg(F.collect_list(F.struct(*columns)).alias(name))

    left = packed(sent, "qblock", "asked", block_rows // 4, "query", "vector")
    right = packed(filed, "block", "held", block_rows, "ids", "vector")
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = left.join(right, "part").repartition(tasks, "part", "qblock", "block").select("asked", "held")

    def compare(stream):
        for batch in stream:
            for r in range(batch.num_rows):
                asking, q = batch.column("asked")[r].values.flatten()
                held, v = batch.column("held")[r].values.flatten()
                names = asking.to_pylist()
                q, v = _matrix(q), _matrix(v)
                owner = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
                members = held.flatten().to_numpy()
                close = q @ v.T
                take = min(k + 1, len(v))
                floor = -np.partition(-close, take - 1, axis=1)[:, take - 1]
                found = []
                for i in range(len(q)):
                    # Rounding of the product depends on a row's place; what may be among the first is summed alike.
                    near = np.flatnonzero(close[i] >= floor[i] - 1e-9 * (1 + abs(floor[i])))
                    exact = np.zeros(len(v))
                    exact[near] = (v[near] * q[i]).sum(axis=1)
                    mine = np.flatnonzero(np.isin(owner, near))
                    score = exact[owner[mine]]
                    order = np.lexsort((members[mine], -score))[:k + 1]
                    found.append([{"less": -float(score[o]), "vec_id": members[mine][o]} for o in order])
                kind = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", held.type.value_type)]))
                yield pa.RecordBatch.from_arrays([pa.array(names, asking.type), pa.array(found, kind)], names=["query", "near"])

    each = work.mapInArrow(compare, f"query {kinds['query']}, near array<struct<less:double,vec_id:{kinds['query']}>>")
    best = each.groupBy("query").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    answers = queries.join(best, "query").select("vector", "near").join(asked, "vector")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("vec_id")), 1, k)
    listed = answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "n"))
    return listed.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"),
        (-F.col("n.less")).alias("score"))
