"""Operator 5, approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors form a class first, so a vector that a third of all rows share is one node; a class keeps its least ids
(as many as an answer can need). Classes of about one norm (bands of a ratio of BAND, BANDS at most; the last takes all that
is shorter) are dealt to shards of about SHARD by hash. In a shard, nodes are inserted in
batches: a greedy search over the graph so far proposes neighbours, pruning keeps a candidate only if no kept one is
ALPHA times closer to it than the node is, and back edges are pruned alike. Queries are searched by beam in every
shard and the best over all shards are kept. A task reads one shard's graph and streams queries past it, so with many
shards each graph moves once; with few, queries are dealt to about TASKS tasks in all.

Largest inner product becomes nearest angle by one more coordinate, which fills every vector up to the largest norm of its
shard. Within a band it stays short, so it does not make unlike vectors look alike.
Scores are recomputed in double precision on the original vectors.

Defined results: rows with a null id, and vectors that are null, zero or not finite take no part; a vector's candidates are
those of its own length, each length has bands and shards of its own; rows of one id are each other's own; with fewer than k
candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import cut, table

K, EVERY = 20, 20
SHARD, DEGREE, ALPHA, WIDTH, BUILD, BATCH, TASKS = 16_384, 32, 1.15, 320, 128, 512, 12
BAND, BANDS = 1.25, 40


def beam(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest nodes found for each query, nearest first (-1: none), and their inner products."""
    n, rows = len(x), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    ids = np.full((len(q), width), n)
    sim = np.full((len(q), width), -np.inf, np.float32)
    open_ = np.zeros((len(q), width), bool)
    s = starts[:width]
    ids[:, : len(s)], open_[:, : len(s)] = s, True
    sim[:, : len(s)] = q @ x[s].T
    seen[:, s] = True
    while True:
        act = np.flatnonzero(open_.any(1))
        if not len(act):
            return np.where(np.isfinite(sim), ids, -1), sim
        col = np.argsort(~open_[act], axis=1, kind="stable")[:, :step]
        a = act[:, None]
        ok = open_[a, col]
        open_[a, col] = False
        near = np.where(ok[:, :, None], graph[np.where(ok, ids[a, col], 0)], n).reshape(len(act), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[a, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(fresh, near, n)
        seen[a, near] = True
        most = int(fresh.sum(1).max())
        if not most:
            continue
        near = np.sort(near, axis=1)[:, :most]
        real = near < n
        new = np.einsum("ad,akd->ak", q[act], x[np.where(real, near, 0)])
        both = np.concatenate([sim[act], np.where(real, new, -np.inf)], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :width]
        r = rows[: len(act)]
        sim[act] = both[r, top]
        ids[act] = np.concatenate([ids[act], near], axis=1)[r, top]
        open_[act] = np.concatenate([open_[act], real], axis=1)[r, top] & np.isfinite(sim[act])


def prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each node out of its candidates (-1: none), nearest first."""
    safe = np.maximum(cand, 0)
    d = 2 - 2 * np.einsum("bd,bcd->bc", x[node], x[safe])
    bad = (cand < 0) | (cand == node[:, None])
    order = np.argsort(np.where(bad, np.inf, d), axis=1, kind="stable")
    r = np.arange(len(node))[:, None]
    cand, d, bad = cand[r, order], d[r, order], bad[r, order]
    same = np.sort(cand, axis=1)
    if (same[:, 1:] == same[:, :-1]).any():  # a candidate listed twice stays once
        first = np.argsort(cand, axis=1, kind="stable")
        again = np.zeros_like(bad)
        again[r, first[:, 1:]] = cand[r, first[:, 1:]] == cand[r, first[:, :-1]]
        bad |= again
    v = x[np.maximum(cand, 0)]
    apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = ~bad
    out = np.full((len(node), degree), -1, np.int32)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, k] = cand[some, pick[some]]
        alive &= alpha * alpha * apart[np.arange(len(node)), pick] > d
        alive[np.arange(len(node)), pick] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, width: int = BUILD) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n x degree, -1: none) and entry nodes."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(n).permutation(n)
    lo = min(n, 4 * degree)
    first = order[:lo]
    graph[first] = prune(x, first, np.tile(first, (lo, 1)), degree, alpha)
    starts = first[: min(8, lo)]
    while lo < n:
        part = order[lo : lo + min(BATCH, lo)]
        found, _ = beam(x, graph, starts, x[part], width)
        inner = np.argsort(-(x[part] @ x[part].T), axis=1)[:, :9]
        graph[part] = prune(x, part, np.concatenate([found, part[inner]], axis=1), degree, alpha)
        src, to = np.repeat(part, degree), graph[part].ravel()
        src, to = src[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        node, at, times = np.unique(to[by], return_index=True, return_counts=True)
        back = np.full((len(node), degree), -1, np.int64)
        group = np.repeat(np.arange(len(node)), times)
        place = np.arange(len(by)) - np.repeat(at, times)
        fit = place < degree  # a node gains at most `degree` back edges a batch; its own list is pruned to that anyway
        back[group[fit], place[fit]] = src[by][fit]
        own = np.concatenate([graph[node], back], axis=1)
        for i in range(0, len(node), BATCH):
            graph[node[i : i + BATCH]] = prune(x, node[i : i + BATCH], own[i : i + BATCH], degree, alpha)
        lo += len(part)
    return graph, starts


def longest(v: np.ndarray) -> float:
    """Largest norm of the rows, without overflow of squares."""
    most = np.abs(v).max()
    return float(most * np.sqrt(((v / most) ** 2).sum(1).max()))


def _index(t: pa.Table) -> pa.Table:
    t = t.combine_chunks().sort_by("c")
    v = np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
    graph, starts = build(lifted(v, longest(v)))
    return pa.table({"shard": t["shard"][:1], "vectors": pa.array([v.tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary()), "starts": pa.array([starts.tolist()], pa.list_(pa.int64())), "ids": pa.array([t["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors whose angles to (q, 0) are ordered as inner products with q."""
    u = v / norm
    return np.concatenate([u, np.sqrt(np.maximum(0, 1 - (u * u).sum(1)))[:, None]], axis=1).astype(np.float32)


def _search(k: int, width: int):
    """Rows of a task: of each (shard, range) its graph, then its queries. The k + 1 nearest classes of each query."""

    class Graph:
        def __init__(self, b: pa.RecordBatch, row: int):
            self.starts, self.ids = np.array(b.column("starts")[row].as_py()), b.column("ids")[row].values
            self.v = np.frombuffer(b.column("vectors")[row].as_py(), np.float64).reshape(len(self.ids), -1)
            self.graph = np.frombuffer(b.column("graph")[row].as_py(), np.int32).reshape(len(self.v), -1)
            self.x = lifted(self.v, longest(self.v))

        def nearest(self, key: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            m = min(k + 1, len(self.v))
            unit = np.concatenate([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros((len(q), 1))], axis=1).astype(np.float32)
            found, _ = beam(self.x, self.graph, self.starts, unit, max(width, m))
            score = np.where(found >= 0, np.einsum("ad,akd->ak", q, self.v[np.maximum(found, 0)]), -np.inf)
            for i in np.flatnonzero((found >= 0).sum(1) < m):  # nodes out of reach: compare with all
                s = self.v @ q[i]
                best = np.argsort(-s, kind="stable")[:m]
                found[i, :m], score[i] = best, -np.inf
                score[i, :m] = s[best]
            top = np.argsort(-score, axis=1, kind="stable")[:, :m]
            r = np.arange(len(top))[:, None]
            return pa.record_batch({"c": np.repeat(key, m), "score": score[r, top].ravel(), "ids": self.ids.take(pa.array(found[r, top].ravel()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            heads = np.flatnonzero(np.asarray(b.column("vectors").is_valid()))
            ends = np.append(heads, b.num_rows)
            for lo, hi in zip(np.append(0, heads + 1), ends, strict=True):
                for at in range(lo, hi, BATCH):
                    part = b.slice(at, min(BATCH, hi - at))
                    yield now.nearest(np.asarray(part.column("c")), np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1))
                if hi < b.num_rows:
                    now = Graph(b, int(hi))

    return run


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """c, v, ids: distinct vectors with their k + 1 least ids, in two steps so that no vector gathers all its rows."""
    salt = F.pmod(F.xxhash64("id"), F.lit(8))
    first = Window.partitionBy("c", "salt").orderBy("id")
    last = Window.partitionBy("c").orderBy("id")
    slim = rows.select("c", "id").distinct().withColumn("salt", salt)
    slim = slim.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    slim = slim.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k + 1)
    ids = slim.groupBy("c").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy("c").agg(F.first("v").alias("v"), F.max("asks").alias("asks")).join(ids, "c")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, shard: int = SHARD, width: int = WIDTH) -> DataFrame:
    """query_id, rank, id, score: the k nearest found for each row that satisfies is_query (a function of the id column)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    rows = cut(rows.withColumn("c", F.xxhash64("v")).withColumn("asks", is_query(F.col("id"))), "vectors")
    sized = _classes(rows, k).withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("d", F.size("v"))
    norm = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))  # squares do not overflow
    classes = cut(sized.withColumn("norm", norm).drop("most"), "classes")
    banded = classes.join(F.broadcast(classes.groupBy("d").agg(F.max("norm").alias("top"))), "d")  # a row a length
    banded = banded.withColumn("band", F.least(F.lit(BANDS), F.floor(F.log(F.col("top") / F.col("norm")) / F.log(F.lit(BAND)))).cast("int"))
    plan, shards, spans = [], 0, {}
    for r in banded.groupBy("d", "band").agg(F.count("*").alias("n")).orderBy("d", "band").collect():  # a row a length and band
        wide = -(-r["n"] // shard)
        plan.append((r["d"], r["band"], shards, wide))
        shards += wide
        spans[r["d"]] = (spans.get(r["d"], (shards - wide,))[0], shards - 1)
    if not plan:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    ranges = max(1, TASKS // shards)
    small = lambda data, kind: F.broadcast(vectors.sparkSession.createDataFrame(data, kind))
    index = banded.join(small(plan, "d int, band int, first int, wide int"), ["d", "band"])
    index = index.withColumn("shard", (F.col("first") + F.pmod("c", F.col("wide"))).cast("int")).select("shard", "c", "v", "ids")
    index = cut(index.groupBy("shard").applyInArrow(_index, "shard int, vectors binary, graph binary, starts array<long>, ids array<array<long>>"), "graph")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = classes.where("asks").join(small([(d, *x) for d, x in spans.items()], "d int, lo int, hi int"), "d")
    queries = queries.select("c", "v", F.pmod(F.xxhash64("c"), F.lit(ranges)).cast("int").alias("range"), F.explode(F.sequence("lo", "hi")).alias("shard"))
    dealt = index.withColumn("range", every(ranges)).unionByName(queries, allowMissingColumns=True)
    dealt = dealt.repartition(shards * ranges, "shard", "range").sortWithinPartitions("shard", "range", F.col("vectors").isNull())
    found = dealt.select("vectors", "graph", "starts", "ids", "c", "v").mapInArrow(_search(k, width), "c long, score double, ids array<long>")
    best = Window.partitionBy("c").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = cut(found.groupBy("c").agg(F.collect_list(F.struct("score", "ids")).alias("hits")), "found")
    asked = rows.where("asks").select("id", "c").distinct().withColumnRenamed("id", "query_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for q, hits in zip(b.column("query_id").to_pylist(), b.column("hits").to_pylist(), strict=True):
                all_ = sorted((-h["score"], i) for h in hits for i in h["ids"] if i != q)[:k]
                for r, (s, i) in enumerate(all_, 1):
                    for to, x in zip(out, (q, r, i, -s), strict=True):
                        to.append(x)
            yield pa.record_batch({"query_id": pa.array(out[0], pa.int64()), "rank": pa.array(out[1], pa.int32()), "id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return asked.join(found, "c").select("query_id", "hits").mapInArrow(answer, "query_id long, rank int, id long, score double")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(EVERY)) == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
