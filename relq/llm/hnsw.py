"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of a bounded size, those of each length to their own, by a hash of their id. A shard's graph is stored as one row of flat
arrays: ids, vectors, and for each layer the nodes and their neighbours. Inner product becomes distance on the unit
sphere of one more dimension, which fills each vector up to the longest length; every layer's lists hold the nearest
nodes that are not nearer to one already chosen, filled up with the nearest others, and links back. Near nodes are
searched in cells cut by random directions, so building takes time in proportion to the vectors. Equal vectors of a
shard are one node. Queries meet every shard of their length in blocks, each pair of both in a task of its own; each shard returns its nearest, scored in double precision
on the vectors as given, and these are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Vectors of a shard, queries of a block.
SHARD, BLOCK = 32_768, 1024
#: Vectors of a cell in which near ones are searched when a graph is built, and ways to cut a shard into cells.
CELL, CUTS = 4096, 3
#: Neighbours on the upper layers (twice as many on the lowest), nodes that a search holds, and that it begins with.
M, EF, SEEDS = 24, 256, 16
INDEX = "shard long, ids binary, starts binary, vectors binary, dim int, layers array<struct<nodes:binary,near:binary,width:int>>"


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by the longest, with one more component that makes each as long as it."""
    x = x / np.sqrt((x**2).sum(1).max())
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))]).astype(np.float32)


def cells(points: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The points halved by random directions until no part holds more than so many."""
    done, todo = [], [np.arange(len(points), dtype=np.int32)]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            done.append(own)
            continue
        along = points[own] @ rng.standard_normal(points.shape[1]).astype(np.float32)
        order = np.argsort(along, kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


def nearest_others(points: np.ndarray, wide: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each point up to wide near others, nearest first (-1: none), and their products with it: the nearest of all in
    its cell, of CUTS halvings into cells of CELL, so that the work grows with the number of points."""
    n, rng = len(points), np.random.Generator(np.random.PCG64(seed))
    cuts = 1 if n <= CELL else CUTS
    found, value = np.full((n, cuts * wide), -1, np.int32), np.full((n, cuts * wide), -np.inf, np.float32)
    for c in range(cuts):
        for own in cells(points, CELL, rng):
            k = min(wide, len(own) - 1)
            for at in range(0, len(own) if k > 0 else 0, 1024):
                rows = own[at : at + 1024]
                near = points[rows] @ points[own].T
                near[np.arange(len(rows)), np.arange(at, at + len(rows))] = -np.inf
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                found[rows, c * wide : c * wide + k], value[rows, c * wide : c * wide + k] = own[top], np.take_along_axis(near, top, 1)
    for at in range(0, n, 4096):
        rows = slice(at, at + 4096)
        if cuts > 1:  # one that two cells gave counts once
            order = np.argsort(found[rows], axis=1, kind="stable")
            f, v = np.take_along_axis(found[rows], order, 1), np.take_along_axis(value[rows], order, 1)
            v[:, 1:][f[:, 1:] == f[:, :-1]] = -np.inf
            found[rows], value[rows] = f, v
        order = np.argsort(-value[rows], axis=1, kind="stable")
        found[rows], value[rows] = np.take_along_axis(found[rows], order, 1), np.take_along_axis(value[rows], order, 1)
    return np.where(np.isfinite(value), found, -1)[:, :wide], value[:, :wide]


def linked(points: np.ndarray, m: int) -> np.ndarray:
    """Neighbour lists of a layer's nodes (-1: none): diverse near nodes, then the nearest others, and links back."""
    n, wide = len(points), min(len(points) - 1, 4 * m)
    lists = np.full((n, m), -1, np.int32)
    if wide <= 0:
        return lists
    near, to = nearest_others(points, wide)
    found: list[list[int]] = []
    for own, reach in zip(near, to):
        own = own[own >= 0]
        between, reach = points[own] @ points[own].T, reach[: len(own)]
        free, chosen = np.ones(len(own), bool), []
        for j in range(len(own)):
            if free[j]:
                chosen.append(j)
                if len(chosen) == m // 2:
                    break
                free &= between[j] <= reach  # nearer to j than to the node: reached through j
        rest = [j for j in range(len(own)) if j not in chosen][: m // 2 + m // 4 - len(chosen)]
        found.append(own[chosen + rest].tolist())
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(found):
        for j in own:
            back[j].append(i)
    for i in range(n):
        held = set(found[i])
        own = found[i] + [j for j in back[i] if j not in held]
        lists[i, : min(m, len(own))] = own[:m]
    return lists


def build(ids: np.ndarray, vectors: np.ndarray, m: int = M, seed: int = 3) -> dict:
    """A shard's graph. Layer 0 holds all distinct vectors, each layer above one in m of the one below."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(of.ravel(), kind="stable")
    starts = np.searchsorted(of.ravel()[by], np.arange(len(distinct) + 1))
    points, rng = lifted(distinct), np.random.Generator(np.random.PCG64(seed))
    layers, nodes = [], np.arange(len(distinct), dtype=np.int32)
    while True:
        near = linked(points[nodes], m if layers else 2 * m)
        layers.append((nodes, np.where(near >= 0, nodes[near], -1).astype(np.int32)))
        if len(nodes) <= m:
            break
        nodes = np.sort(rng.choice(nodes, max(1, len(nodes) // m), replace=False))
    return {"ids": ids[by], "starts": starts.astype(np.int32), "vectors": distinct, "layers": layers}


def search(graph: dict, queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """For each query the nodes found (up to ef, nearest first, -1: none), all queries a step at a time.

    Every query compares the nodes of the lowest upper layer that has no more than CELL and takes the SEEDS nearest; on each
    layer below it goes on with the nearest of these and their neighbours, and on the lowest keeps its ef nearest nodes,
    following the lists of the nearest four not yet followed until there are none.
    """
    points, layers = graph["vectors"].astype(np.float32), graph["layers"]
    q, rows, n = queries.astype(np.float32), np.arange(len(queries)), len(points)
    top = next((k for k in range(1, len(layers)) if len(layers[k][0]) <= CELL), len(layers) - 1)
    ef, nodes = min(ef, n), layers[top][0]
    score = q @ points[nodes].T
    seeds = min(SEEDS, len(nodes), ef)
    pick = np.argpartition(-score, seeds - 1, axis=1)[:, :seeds]
    at, best = nodes[pick].astype(np.int64), np.take_along_axis(score, pick, 1)
    for nodes, near in reversed(layers[1:top]):
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        more = near[place[at]].reshape(len(q), -1).astype(np.int64)
        more = np.sort(np.hstack([at, np.where(more < 0, n, more)]), axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = n
        value = np.where(more < n, np.einsum("qd,qkd->qk", q, points[np.minimum(more, n - 1)]), -np.inf)
        pick = np.argpartition(-value, seeds - 1, axis=1)[:, :seeds]
        at, best = np.take_along_axis(more, pick, 1), np.take_along_axis(value, pick, 1)
    near = layers[0][1]
    seen, done = np.zeros((len(q), n + 1), bool), np.zeros((len(q), n + 1), bool)
    held, score = np.full((len(q), ef), n, np.int64), np.full((len(q), ef), -np.inf, np.float32)
    held[:, :seeds], score[:, :seeds] = at, best
    seen[rows[:, None], at] = True
    seen[:, n] = False
    done[:, n] = True
    active, step = rows, min(4, ef)
    while len(active):
        todo = np.where(done[active[:, None], held[active]], -np.inf, score[active])
        pick = np.argpartition(-todo, step - 1, axis=1)[:, :step]
        live = np.isfinite(np.take_along_axis(todo, pick, 1))
        some = live.any(1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        follow = np.where(live, np.take_along_axis(held[active], pick, 1), n)
        done[active[:, None], follow] = True
        new = np.where((follow < n)[:, :, None], near[np.minimum(follow, n - 1)], -1).reshape(len(active), -1)
        new = np.where(new < 0, n, new).astype(np.int64)
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[active[:, None], new]] = n
        seen[active[:, None], new] = True
        seen[:, n] = False
        fresh = np.full(new.shape, -np.inf, np.float32)
        a, b = np.nonzero(new < n)
        fresh[a, b] = np.einsum("kd,kd->k", q[active[a]], points[new[a, b]])
        all_, value = np.hstack([held[active], new]), np.hstack([score[active], fresh])
        keep = np.argpartition(-value, ef - 1, axis=1)[:, :ef]
        held[active], score[active] = np.take_along_axis(all_, keep, 1), np.take_along_axis(value, keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    held = np.take_along_axis(held, order, 1)
    return np.where(held < n, held, -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, as doubles: not null, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(~bad & F.exists("vector", lambda x: x != 0))


def by_length(column, values: dict[int, int]):
    """The value for a vector's length; lengths that are not there have null."""
    return F.element_at(F.create_map(*(F.lit(x).cast("long") for item in values.items() for x in item)), F.size(column).cast("long")) if values else F.lit(None).cast("long")


def index(vectors: DataFrame, shard_rows: int = SHARD, m: int = M) -> DataFrame:
    """Vectors (vec_id, vector) -> a row of flat arrays for each shard (INDEX).

    Vectors of each length have shards of their own, numbered one after another. Rows that share an id and a length are
    one vector, the least by its components; equal vectors are one node; an empty table gives no shard.
    """
    shards = {r.dim: max(1, math.ceil(r["count"] / shard_rows)) for r in vectors.groupBy(F.size("vector").alias("dim")).count().orderBy("dim").collect()}
    first = {dim: sum(n for d, n in shards.items() if d < dim) for dim in shards}

    def made(rows):
        ids = rows.column("vec_id").to_numpy()
        x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((*x.T[::-1], ids))
        keep = order[np.append(True, ids[order][1:] != ids[order][:-1])]
        g = build(ids[keep], x[keep], m)
        layers = [{"nodes": a.tobytes(), "near": b.tobytes(), "width": b.shape[1]} for a, b in g["layers"]]
        kinds = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("near", pa.binary()), ("width", pa.int32())])))])
        row = {"shard": rows.column("shard")[0].as_py(), "ids": g["ids"].tobytes(), "starts": g["starts"].tobytes(), "vectors": g["vectors"].tobytes(), "dim": x.shape[1], "layers": layers}
        return pa.Table.from_pylist([row], schema=kinds)

    dealt = vectors.withColumn("shard", by_length("vector", first) + F.pmod(F.xxhash64("vec_id"), by_length("vector", shards)))
    return dealt.groupBy("shard").applyInArrow(made, INDEX)


def opened(row: dict) -> dict:
    return {
        "ids": np.frombuffer(row["ids"], np.int64), "starts": np.frombuffer(row["starts"], np.int32), "vectors": np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]),
        "layers": [(np.frombuffer(x["nodes"], np.int32), np.frombuffer(x["near"], np.int32).reshape(-1, x["width"])) for x in row["layers"]],
    }


def nearest(built: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF, block_rows: int = BLOCK) -> DataFrame:
    """Index rows and queries (vec_id, vector) -> query_id, rank, vec_id, score: the k nearest found of each query among
    vectors of its length, its own id left out; nearest first, ties to the smaller id; fewer where there are fewer.

    Queries go to blocks by a hash of their id; each shard's row meets each block once, dealt by both. Queries that share
    an id and a length are one; an empty table on either side gives no rows.
    """
    spark = built.sparkSession
    blocks = max(1, math.ceil(queries.count() / block_rows))
    lengths = built.groupBy("dim").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).collect()
    low, high = ({r.dim: r[c] for r in lengths} for c in ("low", "high"))
    asked = queries.where(by_length("vector", low).isNotNull()).groupBy(by_length("vector", low).alias("low"), by_length("vector", high).alias("high"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long").alias("block"))
    packed = asked.agg(F.collect_list(F.struct("vec_id", "vector")).alias("asked")).select("block", "asked", F.explode(F.sequence("low", "high")).alias("shard"))
    spread = built.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    small_batches(spark, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                g = opened(row)
                asked = sorted({x["vec_id"]: x["vector"] for x in row["asked"]}.items())
                ids, q = np.array([i for i, _ in asked]), np.array([v for _, v in asked])
                out: list[tuple[int, int, float]] = []
                for at in range(0, len(q), 256):
                    for i, own, nodes in zip(ids[at : at + 256], q[at : at + 256], search(g, q[at : at + 256], ef)):
                        nodes = nodes[nodes >= 0][: 2 * k + 1]
                        exact = g["vectors"][nodes] @ own
                        found: list[tuple[float, int]] = []
                        for node, score in zip(nodes.tolist(), exact.tolist()):
                            members = g["ids"][g["starts"][node] : g["starts"][node + 1]][: k + 1]
                            found += [(-score, v) for v in members.tolist() if v != i]
                        out += [(int(i), v, -s) for s, v in sorted(found)[:k]]
                columns = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = spread.join(packed, ["shard", "block"]).mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return nearest(materialize(index(vectors), "hnsw"), vectors.where(F.col("vec_id") % 20 == 0))
