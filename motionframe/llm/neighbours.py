"""Approximate nearest entities by inner product: a robust-pruned graph per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from motionframe.session import ship_package

SHARD_ROWS = 8_192      # vectors of one graph; the number of shards follows the input
QUERY_ROWS = 4_096      # queries that one task holds
DEGREE = 32             # out-edges of a node
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2             # relaxation of the pruning rule
EXPAND = 4              # nodes opened per step of a search
STARTS = 32             # entry points of a search
BATCH = 256             # searches that advance together
_NONE = np.iinfo(np.int64).min  # stands where a node has no further key


def _nearest_first(ids: np.ndarray, dist: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts candidate rows by distance, clears repeats and cuts to `width`."""
    order = np.lexsort((ids, dist), axis=-1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    if again.any():
        dist[again], ids[again] = np.inf, -1
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return ids[:, :width], dist[:, :width]


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int,
                inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for a block of queries at once: per query the `width` nearest nodes met, -1 where fewer.

    Nearest by squared distance (less the query's own square), or by inner product.
    """
    norm = np.zeros(len(x), x.dtype) if inner else np.einsum("ij,ij->i", x, x)
    ids = np.repeat(starts[None, :], len(q), 0)
    dist = norm[ids] - 2 * (q @ x[starts].T)
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, ids] = True
    if ids.shape[1] < width:
        pad = width - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
        dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    ids, dist = _nearest_first(ids, dist, width)
    opened = np.zeros((len(q), len(x)), bool)
    active = np.arange(len(q))
    while len(active):
        own, far = ids[active], dist[active]
        waiting = np.isfinite(far) & ~opened[active[:, None], own]
        # the first few unopened ones of each row, which is sorted
        rank = np.cumsum(waiting, axis=1)
        pick = waiting & (rank <= EXPAND)
        going = pick.any(axis=1)
        active, own, far, pick = active[going], own[going], far[going], pick[going]
        if not len(active):
            break
        slot = np.argsort(~pick, axis=1, kind="stable")[:, :EXPAND]
        nodes = np.where(np.take_along_axis(pick, slot, 1), np.take_along_axis(own, slot, 1), -1)
        at = active[:, None]
        opened[np.broadcast_to(at, nodes.shape)[nodes >= 0], nodes[nodes >= 0]] = True
        near = np.where((nodes >= 0)[:, :, None], edges[nodes], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[at, near]
        seen[np.broadcast_to(at, near.shape)[fresh], near[fresh]] = True
        far_new = np.full(near.shape, np.inf, np.float32)
        row, _ = np.nonzero(fresh)
        to = near[fresh]
        far_new[fresh] = norm[to] - 2 * np.einsum("ij,ij->i", q[active[row]], x[to])
        ids_new = np.where(fresh, near, -1)
        ids[active], dist[active] = _nearest_first(np.concatenate([own, ids_new], 1), np.concatenate([far, far_new], 1), width)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges for a block of nodes from candidates (-1: none).

    The nearest candidate stays and drops every other one that is `alpha` times closer
    to it than to the node; then the next, until `degree` are chosen.
    """
    ids = np.where(ids == nodes[:, None], -1, ids)
    dist = np.square(x[ids] - x[nodes][:, None, :]).sum(-1)
    dist[ids < 0] = np.inf
    ids, dist = _nearest_first(ids, dist, ids.shape[1])
    points = x[ids]
    norm = np.einsum("bcd,bcd->bc", points, points)
    between = norm[:, :, None] + norm[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = np.isfinite(dist)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for r in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, r] = ids[rows[some], pick[some]]
        alive &= ~((alpha * alpha * between[rows, pick] <= dist) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Directed graph over the rows of x and its entry points, `first` among them.

    Rows join in growing batches in a random order: a search in the graph so far
    proposes neighbours, pruning keeps diverse ones, and back edges are pruned likewise.
    """
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.RandomState(3).permutation(n)
    if first is not None:
        order = np.concatenate([first, order[~np.isin(order, first)]])
    starts = order[:min(n, STARTS)].astype(np.int32)
    done = min(n, 2 * degree)
    seed = order[:done]
    edges[seed] = robust_prune(x, seed, np.repeat(seed[None, :].astype(np.int32), done, 0), degree, alpha)
    while done < n:
        batch = order[done:done + min(done, BATCH)]
        ids, _ = beam_search(x, edges, starts, x[batch], beam)
        edges[batch] = robust_prune(x, batch, ids, degree, alpha)
        source = np.repeat(batch, degree).astype(np.int32)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, at, count = np.unique(target, return_index=True, return_counts=True)
        # incoming edges in columns; beyond `degree` at once they would be pruned anyway
        place = np.arange(len(target)) - np.repeat(at, count)
        incoming = np.full((len(nodes), min(int(count.max()), degree)), -1, np.int32)
        fits = place < incoming.shape[1]
        incoming[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
        for a in range(0, len(nodes), 1024):
            part = nodes[a:a + 1024]
            both = np.concatenate([edges[part], incoming[a:a + 1024]], 1)
            room = (both >= 0).sum(1) <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            edges[part[room]] = packed[room]
            if not room.all():
                edges[part[~room]] = robust_prune(x, part[~room], both[~room], degree, alpha)
        done += len(batch)
    return edges, starts


def _directions(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.square(x).sum(1, keepdims=True))).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over the longest one's length, so that 32-bit numbers hold them."""
    return (x / np.sqrt(np.square(x).sum(1).max())).astype(np.float32)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, key: str, features: str) -> DataFrame:
    """(entity_id, features, dim) without NULL, zero and non-finite vectors or NULL keys."""
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("entity_id"), F.col(features).cast("array<double>").alias("features"))
    inf = F.lit(float("inf"))
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf))
    zero = ~F.exists("features", lambda v: v != 0)
    return rows.where(F.col("features").isNotNull() & ~bad & ~zero).withColumn("dim", F.size("features"))


_INDEX = "dim int, shard int, n int, vectors binary, ids binary, edges binary, starts binary"


def build_index(vectors: DataFrame, k: int, *, key: str = "entity_id", features: str = "features",
                shards: int | None = None) -> DataFrame:
    """One row per shard with its distinct vectors, their smallest k + 1 keys, and the graph.

    The graph joins near directions; searches walk it by inner product and begin, among
    others, at the longest vectors, where large inner products are found. That keeps
    recall for vectors of any lengths, which a graph of the vectors themselves does not.

    Shards are by hash of the key, so copies of one vector spread over all of them.
    Within a shard equal vectors are one node. k + 1 keys are enough for an exact answer
    among copies: a query drops only itself.
    """
    ship_package(vectors.sparkSession)
    rows = usable(vectors, key, features)
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("entity_id"), F.lit(shards)).cast("int"))

    def build(key, table):
        dim = key[0].as_py()
        ids = table["entity_id"].to_numpy()
        x = _matrix(table["features"], dim) + 0.0  # no negative zeros: equal vectors have equal bytes
        _, first, group = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        x = x[first]
        by = np.lexsort((ids, group))
        at = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
        place = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
        own = np.full((len(x), min(k + 1, int(place.max()) + 1)), _NONE)
        fits = place < own.shape[1]
        own[group[by][fits], place[fits]] = ids[by][fits]
        longest = np.argsort(-np.square(x).sum(1), kind="stable")[:STARTS // 2]
        edges, starts = build_graph(_directions(x), first=longest)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
                         "n": pa.array([len(x)], pa.int32()), "vectors": [x.tobytes()], "ids": [own.tobytes()],
                         "edges": [edges.tobytes()], "starts": [starts.tobytes()]})

    return rows.groupBy("dim", "shard").applyInArrow(build, _INDEX)


_FOUND = "query_id long, vec_id long, score double"


def _search_shard(index: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    out = [[], [], []]
    for row in index.to_pylist():
        n, dim = row["n"], row["dim"]
        x = np.frombuffer(row["vectors"]).reshape(n, dim)
        own = np.frombuffer(row["ids"], np.int64).reshape(n, -1)
        edges = np.frombuffer(row["edges"], np.int32).reshape(n, -1)
        starts = np.frombuffer(row["starts"], np.int32)
        if n <= beam:
            starts = np.arange(n, dtype=np.int32)  # a shard within the beam is looked at whole
        scaled = _scaled(x)
        q_ids, q = queries["entity_id"].to_numpy(), _matrix(queries["features"], dim)
        for at in range(0, len(q), BATCH):
            part, part_ids = q[at:at + BATCH], q_ids[at:at + BATCH]
            ids, _ = beam_search(scaled, edges, starts, _directions(part), beam, inner=True)
            score = np.einsum("bcd,bd->bc", x[ids], part)
            found = own[ids]
            found[ids < 0] = _NONE
            score = np.repeat(score[:, :, None], found.shape[2], 2).reshape(len(part), -1)
            found = found.reshape(len(part), -1)
            ok = (found != _NONE) & (found != part_ids[:, None])
            score = np.where(ok, score, -np.inf)
            best = np.lexsort((found, -score), axis=-1)[:, :k]
            take = np.take_along_axis(ok, best, 1)
            out[0].append(np.repeat(part_ids[:, None], best.shape[1], 1)[take])
            out[1].append(np.take_along_axis(found, best, 1)[take])
            out[2].append(np.take_along_axis(score, best, 1)[take])
    types = [np.int64, np.int64, np.float64]
    return pa.table({name: np.concatenate(c) if c else np.zeros(0, t)
                     for name, c, t in zip(("query_id", "vec_id", "score"), out, types)})


def nearest_entities(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "entity_id",
                     features: str = "features", beam: int = SEARCH_BEAM, shards: int | None = None) -> DataFrame:
    """The k entities with the largest inner product found for each query, all shards searched.

    Returns (query_id, rank, entity_id, score), nearest first, ties to the smaller key,
    never the query itself. Scores are double-precision inner products of the original
    vectors. Vectors that are NULL, all zero, or hold NULL or non-finite values take no
    part, nor do rows with a NULL key; vectors of another length are searched among
    their own kind. Repeated (key, vector) rows count once per copy kept. Fewer than k
    candidates give fewer rows, an empty table none. Other columns are ignored.

    Queries meet shards in blocks of QUERY_ROWS, each a task of bounded memory; a shard
    answers with k rows at most, and these are ranked per query.
    """
    index = build_index(vectors, k, key=key, features=features, shards=shards)
    asked = usable(queries, key, features)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shards = shards or max(1, -(-usable(vectors, key, features).count() // SHARD_ROWS))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("entity_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    place = ("dim", "shard", "block")
    found = index.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(
        lambda left, right: _search_shard(left, right, k, beam), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("entity_id"), "score")
