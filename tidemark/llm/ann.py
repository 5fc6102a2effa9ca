"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by a hash of their id, so every shard is a fair sample and none grows
beyond a bound. In a shard equal vectors are one node. Nodes enter the graph in batches of doubling
size: a greedy beam search from the entry node proposes neighbours, relaxed distance pruning keeps
diverse ones, reverse edges are added and pruned again. Inner product is turned into distance by one
added coordinate that gives all vectors the same norm. A query is beam-searched in every shard and
the shards' best are merged by their exact scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stored

_BLOCK = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): rows with an id whose vector has the common length, only finite components and is not zero.

    Of lengths equally common the smaller counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(sound)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.agg(F.max(F.struct("n", -F.col("d"))).alias("m")).select((-F.col("m.col2")).alias("d"))
    return rows.join(F.broadcast(common), F.size("embedding") == F.col("d")).drop("d")


def _single(x: np.ndarray, *, each: bool = False) -> np.ndarray:
    """Single precision after division by the greatest component, of all rows or of each: a positive factor changes no order of inner products."""
    top = np.abs(x).max(axis=1 if each else None, keepdims=True, initial=0)
    return (x / np.maximum(top, np.finfo(np.float64).tiny)).astype(np.float32)


def _lifted(x: np.ndarray) -> np.ndarray:
    x = _single(x).astype(np.float64)
    norms = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32)


def _beam(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` best nodes by inner product found for each query (ids, -1 where fewer; scores), all queries in step.

    Every round expands each query's best unexpanded node, until none of its beam is unexpanded.
    """
    q, n = len(queries), len(points)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for padding
    seen[:, entry] = seen[:, n] = True
    ids = np.full((q, width), -1, np.int64)
    scores = np.full((q, width), -np.inf, np.float32)
    ids[:, 0], scores[:, 0] = entry, queries @ points[entry]
    done = np.ones((q, width), bool)
    done[:, 0] = False
    live = rows
    while len(live):
        place = np.where(done[live], -np.inf, scores[live]).argmax(1)
        node = ids[live, place]
        done[live, place] = True
        near = graph[node]
        near = np.where(near >= 0, near, n)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(fresh, near, 0)
        found = np.where(fresh, np.einsum("qrd,qd->qr", points[near], queries[live]), -np.inf).astype(np.float32)
        all_scores = np.concatenate([scores[live], found], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        ids[live], scores[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_scores, all_done))
        live = live[~done[live].all(1)]
    return ids, scores


def _pruned(points: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: nearest candidate first, dropping those that a kept one is alpha times nearer to than the node is."""
    b, c = candidates.shape
    candidates = np.sort(candidates, axis=1)  # copies of one stay neighbours among equal distances
    good = (candidates >= 0) & (candidates != node[:, None])
    x = points[np.where(good, candidates, 0)]
    away = ((x - points[node][:, None]) ** 2).sum(2)
    order = np.argsort(np.where(good, away, np.inf), axis=1, kind="stable")
    candidates, good, away = (np.take_along_axis(v, order, 1) for v in (candidates, good, away))
    x = np.take_along_axis(x, order[:, :, None], 1)
    good[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    norms = (x * x).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.einsum("bcd,bed->bce", x, x, optimize=True)
    out = np.full((b, degree), -1, np.int64)
    count = np.zeros(b, np.int64)
    for i in range(c):
        take = good[:, i] & (count < degree)
        out[take, count[take]] = candidates[take, i]
        count += take
        good &= ~(take[:, None] & (alpha * alpha * between[:, i] <= away))
    return out


def build_graph(x: np.ndarray, *, degree: int = 48, width: int = 96, alpha: float = 1.2) -> tuple[np.ndarray, int]:
    """(neighbours with -1 as padding, entry node) over distinct vectors."""
    points = _lifted(x)
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.r_[entry, order[order != entry]]
    at, size = 1, 1
    while at < n:
        batch = order[at : at + min(size, 512)]
        proposed: list[np.ndarray] = []
        for i in range(0, len(batch), _BLOCK):
            part = batch[i : i + _BLOCK]
            found, _ = _beam_near(points, graph, entry, part, width)
            proposed.append(np.concatenate([found, np.tile(batch[:16], (len(part), 1))], 1) if at < 64 else found)
        near = _pruned(points, batch, np.concatenate(proposed), degree, alpha)
        graph[batch] = near
        back: dict[int, list[int]] = {}
        for node, row in zip(batch.tolist(), near.tolist(), strict=True):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        over: list[tuple[int, list[int]]] = []
        for other, nodes in back.items():
            have = graph[other]
            free = np.flatnonzero(have < 0)
            extra = [v for v in nodes if v not in have]
            if len(extra) <= len(free):
                graph[other, free[: len(extra)]] = extra
            else:
                over.append((other, [*have[have >= 0].tolist(), *extra]))
        for i in range(0, len(over), _BLOCK):
            part = over[i : i + _BLOCK]
            most = max(len(c) for _, c in part)
            padded = np.array([c + [-1] * (most - len(c)) for _, c in part])
            nodes = np.array([o for o, _ in part])
            graph[nodes] = _pruned(points, nodes, padded, degree, alpha)
        at, size = at + len(batch), size * 2
    return graph, entry


def _beam_near(points: np.ndarray, graph: np.ndarray, entry: int, nodes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for the lifted points themselves: they share one norm, so inner product orders by distance."""
    return _beam(points, graph, entry, points[nodes], width)


def _shard_index(ids: np.ndarray, x: np.ndarray, degree: int, width: int, alpha: float) -> bytes:
    """A pickled index: distinct vectors, their graph, and the ids of each node in ascending order."""
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.lexsort((ids, of))
    starts = np.searchsorted(of[order], np.arange(len(distinct) + 1))
    graph, entry = build_graph(distinct, degree=degree, width=width, alpha=alpha)
    return pickle.dumps((distinct, graph.astype(np.int32), entry, ids[order], starts))


def build_index(vectors: DataFrame, *, shards: int, degree: int = 48, width: int = 96, alpha: float = 1.2) -> DataFrame:
    """(shard, index): one stored row for each shard; `vectors` as usable() returns them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = -1, []

        def done() -> pa.RecordBatch:
            index = _shard_index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), degree, width, alpha)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([index], pa.binary())], names=["shard", "index"])

        for batch in batches:
            shard, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
            for s in np.unique(shard):
                if parts and s != at:
                    yield done()
                    parts = []
                at = int(s)
                parts.append((ids[shard == s], x[shard == s]))
        if parts:
            yield done()

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    dealt = vectors.select(shard.alias("shard"), "vec_id", "embedding").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(build, "shard int, index binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, *, shards: int, k: int = 20, width: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each (vec_id, embedding) query, its own id left out.

    Scores are inner products of the original vectors in double precision; ties go to smaller ids.
    Each query id is to come once.
    Each shard's index meets the stream of all queries in blocks, and answers k rows a query.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, tuple] = {}  # one shard at a time
        blobs: dict[int, bytes] = {}
        for batch in batches:
            shard, blob, ids, vectors = (batch.column(i) for i in range(4))
            kinds = np.asarray(shard.to_numpy())
            for s, b in zip(kinds.tolist(), blob.to_pylist(), strict=True):
                if b is not None:
                    blobs[s] = b
            asked = ids.is_valid().to_numpy(zero_copy_only=False)
            for s in np.unique(kinds[asked]):
                if int(s) not in loaded:
                    if int(s) not in blobs:
                        continue
                    loaded.clear()
                    found_index = pickle.loads(blobs.pop(int(s)))  # noqa: S301  written by build_index
                    loaded[int(s)] = (*found_index, _single(found_index[0]))
                distinct, graph, entry, members, starts, narrow = loaded[int(s)]
                rows = pa.array(np.flatnonzero(asked & (kinds == s)))
                own = ids.take(rows).to_numpy()
                x = vectors.take(rows).flatten().to_numpy().reshape(len(own), -1)
                for i in range(0, len(own), _BLOCK):
                    nodes, _ = _beam(narrow, graph, entry, _single(x[i : i + _BLOCK], each=True), width)
                    out_q, out_v, out_s = [], [], []
                    for q, vector, found in zip(own[i : i + _BLOCK], x[i : i + _BLOCK], nodes, strict=True):
                        found = found[found >= 0]
                        exact = (distinct[found] * vector).sum(1)
                        best = np.argsort(-exact, kind="stable")
                        got_v, got_s, count = [], [], 0
                        for node, score in zip(found[best], exact[best], strict=True):
                            if count >= k and score < got_s[-1]:
                                break
                            mine = members[starts[node] : starts[node + 1]][: k + 1]
                            mine = mine[mine != q]
                            got_v += mine.tolist()
                            got_s += [float(score)] * len(mine)
                            count += len(mine)
                        top = sorted(zip([-s for s in got_s], got_v, strict=True))[:k]
                        out_q.append(int(q))
                        out_v.append([v for _, v in top])
                        out_s.append([-s for s, _ in top])
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("binary").alias("index"), "vec_id", "embedding")
    stocked = index.select("shard", "index", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    both = stocked.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("index").isNull())
    answers = both.mapInArrow(answer, "query_id long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p.scores).alias("below"), p.ids.alias("id")))
    merged = answers.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))  # k rows a shard
    return merged.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.below")).alias("score"))


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, shard_rows: int = 25_000, least_shards: int = 16, degree: int = 48, width: int = 128) -> DataFrame:
    """Neighbours of the vectors whose id is divisible by `every` among all others.

    Rows that usable() leaves out take no part. Repeated rows are candidates of their own, a query's
    own id is none; of several vectors with a query's id the smallest, component by component, is searched. Fewer candidates than k are all returned. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    sound = stored(usable(vectors), "vectors")
    shards = max(least_shards, -(-sound.count() // shard_rows))
    index = build_index(sound, shards=shards, degree=degree)
    queries = sound.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(index, queries, shards=shards, k=k, width=width)
