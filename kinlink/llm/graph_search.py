"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors form one node that keeps its smallest ids, as many as an answer
can use.  Nodes are dealt to shards by hash.  In a shard, nodes are inserted in
growing batches: a greedy beam search from the entry node proposes neighbours,
and relaxed distance pruning keeps the nearest proposal and drops those that
lie closer to it, by the factor ``ALPHA``, than to the new node, until
``DEGREE`` diverse edges are left.  Edges are also added backwards, pruned
again where a node has too many.  Every query is searched in each shard by a
beam search, the beam's nodes are measured exactly in double precision, and the
shards' answers are merged.

Queries are cut into blocks and a (shard, block) pair is one task, so no task
holds more than a shard and a block.  A shard of at most ``2 * BEAM`` nodes is
read whole.

Vectors that are null, zero, or hold null or non-finite components take no
part.  Vectors of different lengths are never compared.  Rows that repeat both
id and vector count once.  Ties go to the smaller id.  No usable rows give no
rows; other columns than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Edges kept by pruning; a node may gather twice as many before it is pruned again.
DEGREE, ALPHA = 32, 1.2
#: Beam of the searches that propose neighbours, and of those that answer queries.
PROPOSE, BEAM = 64, 128
#: Nodes expanded at a time.
AT_ONCE = 4
#: Nodes of a shard, and queries of a block.
SHARD, BLOCK = 8192, 4096


def _near(x: np.ndarray, norm: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances, but for the query's own norm, from q (m, d) to x[rows] (m, k)."""
    return norm[rows] - 2.0 * np.matmul(x[rows], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, norm: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, relative distances) of the beams of q, nearest first; -1 where a beam isn't full."""
    m = len(q)
    nodes, far = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
    nodes[:, 0], far[:, 0] = entry, _near(x, norm, np.full((m, 1), entry), q)[:, 0]
    closed = np.zeros((m, width), bool)
    met = np.zeros((m, len(x)), bool)
    met[:, entry] = True
    active = np.arange(m)
    while len(active):
        own, dist, done = nodes[active], far[active], closed[active]
        waiting = (own >= 0) & ~done
        # the nearest nodes not expanded yet: beams are in order
        first = waiting & (np.cumsum(waiting, 1) <= AT_ONCE)
        some = first.any(1)
        active, own, dist, done, first = active[some], own[some], dist[some], done[some], first[some]
        if not len(active):
            break
        done |= first
        r, c = np.nonzero(first)
        place = (np.cumsum(first, 1) - 1)[r, c]
        opened = np.full((len(active), AT_ONCE), -1, np.int64)
        opened[r, place] = own[r, c]
        out = np.where(opened[:, :, None] >= 0, edges[opened], -1).reshape(len(active), -1)
        out.sort(1)
        fresh = (out >= 0) & ~met[active[:, None], out]
        fresh[:, 1:] &= out[:, 1:] != out[:, :-1]
        out = np.where(fresh, out, -1)
        keep = max(1, int(fresh.sum(1).max(initial=0)))
        out = -np.sort(-out, 1)[:, :keep]
        fresh = out >= 0
        r, c = np.nonzero(fresh)
        met[active[r], out[r, c]] = True
        d = np.where(fresh, _near(x, norm, out, q[active]), np.inf).astype(np.float32)
        own, dist, done = np.concatenate([own, out], 1), np.concatenate([dist, d], 1), np.concatenate([done, np.zeros(out.shape, bool)], 1)
        by = np.argsort(dist, 1, kind="stable")[:, :width]
        nodes[active], far[active], closed[active] = (np.take_along_axis(v, by, 1) for v in (own, dist, done))
    return nodes, far


def prune(x: np.ndarray, of: np.ndarray, proposed: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse nodes of ``proposed`` (m, k; -1 for none) for each node of ``of`` (m)."""
    m, k = proposed.shape
    vectors = x[proposed]
    d = ((vectors - x[of][:, None, :]) ** 2).sum(-1)
    alive = (proposed >= 0) & (proposed != of[:, None])
    between = np.maximum(0, (vectors**2).sum(-1)[:, :, None] + (vectors**2).sum(-1)[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)))
    out = np.full((m, DEGREE), -1, np.int64)
    rows = np.arange(m)
    for j in range(DEGREE):
        best = np.where(alive, d, np.inf).argmin(1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, j] = proposed[ok, best[ok]]
        alive &= ~((ALPHA * ALPHA * between[rows, best] <= d) & ok[:, None])
        alive[rows, best] = False
    return out


def build(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges (n, 2 * DEGREE; -1 for none), entry) of the graph over x (n, d)."""
    n = len(x)
    norm = (x**2).sum(1)
    edges, degree = np.full((n, 2 * DEGREE), -1, np.int64), np.zeros(n, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    at = 0
    while at < len(order):
        batch = order[at : at + min(256, max(1, at))]
        at += len(batch)
        proposed, _ = beam_search(x, norm, edges, entry, x[batch], PROPOSE)
        kept = prune(x, batch, proposed)
        edges[batch, :DEGREE], degree[batch] = kept, (kept >= 0).sum(1)
        source, target = np.repeat(batch, DEGREE)[kept.reshape(-1) >= 0], kept[kept >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        full = degree[nodes] + count > 2 * DEGREE
        rank = np.arange(len(target)) - np.repeat(start, count)
        fits = ~np.repeat(full, count)
        edges[target[fits], degree[target[fits]] + rank[fits]] = source[fits]
        degree[nodes[~full]] += count[~full]
        for k in range(0, int(full.sum()), 64):
            some = np.flatnonzero(full)[k : k + 64]
            width = 2 * DEGREE + int(count[some].max())
            pool = np.full((len(some), width), -1, np.int64)
            for i, j in enumerate(some):
                node, new = nodes[j], source[start[j] : start[j] + count[j]]
                pool[i, : degree[node]] = edges[node, : degree[node]]
                pool[i, 2 * DEGREE : 2 * DEGREE + len(new)] = new
            kept = prune(x, nodes[some], pool)
            edges[nodes[some]] = -1
            edges[nodes[some], :DEGREE], degree[nodes[some]] = kept, (kept >= 0).sum(1)
    return edges, entry


def _scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(vectors / scale, -1e15, 1e15).astype(np.float32)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """The graph of a shard: one row, with its nodes packed."""
    group = group.sort_values("least")
    x = np.stack([np.asarray(v, np.float64) for v in group["vector"]])
    edges, entry = build(_scaled(x, np.abs(x).max())) if len(x) > 2 * BEAM else (np.zeros((0, 2 * DEGREE), np.int64), 0)
    return pd.DataFrame([{"dim": int(group["dim"].iloc[0]), "shard": int(group["shard"].iloc[0]), "vectors": x.tobytes(), "ids": list(group["ids"]), "edges": edges.astype(np.int32).tobytes(), "entry": entry}])


def _answers(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for shard in index.itertuples() if len(queries) else ():
            x = np.frombuffer(shard.vectors, np.float64).reshape(len(shard.ids), -1)
            edges = np.frombuffer(shard.edges, np.int32).astype(np.int64).reshape(-1, 2 * DEGREE)
            scale = np.abs(x).max()
            small = _scaled(x, scale)
            norm = (small**2).sum(1)
            for a in range(0, len(queries), 512):
                some = queries.iloc[a : a + 512]
                q = np.stack([np.asarray(v, np.float64) for v in some["vector"]])
                beams = beam_search(small, norm, edges, shard.entry, _scaled(q, scale), BEAM)[0] if len(edges) else np.tile(np.arange(len(x)), (len(q), 1))
                for i, query_id in enumerate(some["query_id"]):
                    nodes = beams[i][beams[i] >= 0]
                    exact = np.sqrt(((x[nodes] - q[i]) ** 2).sum(1))
                    found = sorted((float(exact[j]), int(v)) for j in range(len(nodes)) for v in shard.ids[nodes[j]] if v != query_id)[:k]
                    out["query_id"] += [query_id] * len(found)
                    out["vec_id"] += [v for _, v in found]
                    out["score"] += [s for s, _ in found]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>, dim) of the rows that take part."""
    vector = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda v: v != 0)).withColumn("dim", F.size("vector"))


def build_index(rows: DataFrame, k: int, shard_size: int = SHARD) -> DataFrame:
    """One row for each shard with its vectors, ids and graph, from :func:`usable` rows."""
    hashed = rows.withColumn("hash", F.xxhash64("vector"))
    # of equal vectors, an answer can use the k smallest ids besides the query's own; each task keeps no more; no row repeats
    rank = F.rank().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    first = hashed.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    nodes = saved(first.groupBy("hash", "vector", "dim").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_size).alias("shards"))
    count = max(1, int(shards.agg(F.sum("shards")).first()[0] or 0))
    dealt = nodes.join(shards, "dim").select("dim", F.pmod("hash", "shards").alias("shard"), "vector", "ids", F.col("ids")[0].alias("least"))
    # a number of partitions that is given is not merged: no task builds the graphs of many shards
    dealt = dealt.repartition(count, "dim", "shard")
    return saved(dealt.groupBy("dim", "shard").applyInPandas(_index, "dim int, shard long, vectors binary, ids array<array<long>>, edges binary, entry int"), "graphs")


def search(vectors: DataFrame, every: int = 100, k: int = 10, shard_size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows whose vec_id is divisible by ``every``."""
    rows = saved(usable(vectors).distinct(), "vectors")
    index = build_index(rows, k, shard_size)
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", "dim")
    blocks = max(1, -(-queries.count() // block))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # the shards that each query visits
    places = index.filter("block = 0").groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    sent = queries.join(places, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    sent = sent.select("query_id", "vector", "dim", "block", F.explode("shards").alias("shard"))
    keys = ["dim", "shard", "block"]
    tasks = max(1, index.count())
    index, sent = index.repartition(tasks, *keys), sent.repartition(tasks, *keys)
    found = index.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_answers(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
