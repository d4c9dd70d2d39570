"""Approximate nearest neighbours by NN-descent and greedy graph search.

Largest inner products are sought. Vectors get one more component that makes all
norms equal, so that near in the graph means near by inner product; queries have 0
there. Equal vectors are one node. Nodes are dealt to shards of bounded size about
coarse centres; within a shard a neighbour graph starts from small random-hyperplane
blocks and is built by NN-descent: joins bring the neighbours of every node together,
and whichever of them are nearer to one another than their present neighbours become
candidates, round by round until little changes. A query goes to the shards about its
nearest centres and walks their graphs greedily with a pool of the best nodes seen; the
best of all are ranked. A walk starts from the query's own node and the nearest of a
layer of entry points, every LAYER-th node and one of each part of the graph, so that
groups without links between them are reached.

The centres are fitted on at most SAMPLE vectors; all vectors are indexed. A shard's
graph and a block of queries meet in one task; both have a fixed bound.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, neither as queries nor as candidates; shorter vectors count as ending in zeros;
null ids take no part; rows of equal ids and vectors count once, rows of equal ids and
different vectors each for themselves; ties go to the smaller id; fewer candidates than
asked for give fewer rows; an empty table gives an empty result; other input columns do
not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_batches, discard, written

SHARD, QUERY_BLOCK, SAMPLE, PROBES = 60_000, 16_384, 20_000, 8
#: Nodes of a block that a graph starts from, and how many such blocks a node is in.
BLOCK, TABLES = 64, 3
#: Neighbours kept, neighbours joined, candidates each joined one offers, rounds at most, and growth below which they end.
NEIGHBOURS, JOINED, OFFERED, ROUNDS, SETTLED = 32, 48, 3, 8, 0.002
POOL, LAYER = 320, 16
SCHEMA = "query_id bigint, rank int, vec_id bigint, score double, scored bigint"


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _floats(col, width: int) -> np.ndarray:
    raw, off = K.string_bytes(col)
    return np.frombuffer(raw.tobytes(), np.float32).reshape(len(off) - 1, width)


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row."""
    k = min(k, sim.shape[1])
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(sim, at, 1)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """id, vec of the rows that take part, all as long as the longest, and that length."""
    v = F.col("vec")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec")))).distinct(), width


def centres(x: np.ndarray, k: int, steps: int = 8, seed: int = 11) -> np.ndarray:
    """k centres of the rows of x, by Lloyd's steps from random rows."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(steps):
        at = nearest_centres(x, c, 1)[:, 0]
        size = np.bincount(at, minlength=k)
        for j in range(c.shape[1]):
            c[:, j] = np.where(size > 0, np.bincount(at, x[:, j], minlength=k) / np.maximum(size, 1), c[:, j])
    return c


def nearest_centres(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row."""
    far = (c * c).sum(1) / 2 - x @ c.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def graph(nodes: DataFrame, width: int, seed: int = 7) -> DataFrame:
    """v, u, sim: the neighbours of each node. nodes: shard, node, vec (width float32 as bytes)."""
    planes = np.random.default_rng(seed).standard_normal((TABLES, 24, width)).astype(np.float32)
    sizes = nodes.groupBy("shard").agg(F.count("*").alias("in_shard"))
    sized = nodes.join(sizes, "shard")

    def place(batches):
        for batch in batches:
            x = _floats(_column(batch, "vec"), width)
            n = _column(batch, "in_shard").to_numpy()
            bits = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / BLOCK))).astype(np.int64)
            for t in range(TABLES):
                sign = (x @ planes[t].T > 0).astype(np.int64)
                code = (sign << np.arange(24)).sum(1) & ((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([_column(batch, "shard"), pa.array(np.full(len(x), t, np.int32)), pa.array(code), _column(batch, "node"), _column(batch, "vec")], names=["shard", "t", "code", "node", "vec"])

    placed = sized.mapInArrow(place, "shard int, t int, code bigint, node bigint, vec binary")
    full = placed.groupBy("shard", "t", "code").agg(F.count("*").alias("in_block"))
    placed = placed.join(full, ["shard", "t", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("in_block") / (2 * BLOCK))))

    def exact(part: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(part["vec"]), np.float32).reshape(len(part), width)
        node = part["node"].to_numpy()
        out = []
        for a in range(0, len(x), 512):
            sim = x[a : a + 512] @ x.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -np.inf
            at, s = _best(sim, NEIGHBOURS)
            out.append((np.repeat(node[a : a + 512], at.shape[1]), node[at].ravel(), s.ravel()))
        v, u, s = (np.concatenate(c) for c in zip(*out, strict=True))
        ok = np.isfinite(s)
        return pd.DataFrame({"v": v[ok], "u": u[ok], "sim": s[ok]})

    edges = placed.groupBy("shard", "t", "code", "part").applyInPandas(exact, "v bigint, u bigint, sim float")
    rank = Window.partitionBy("v").orderBy(F.desc("sim"), "u")

    def nearest(e: DataFrame, n: int) -> DataFrame:
        return e.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("born").alias("born")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= n).drop("r")

    rows = NEIGHBOURS * nodes.count()
    edges = written(nearest(edges.withColumn("born", F.lit(0)), NEIGHBOURS), "graph", rows, 200_000)

    def meet(batches):
        for batch in batches:
            lists = _column(batch, "met")
            inner, off = lists.flatten(), lists.offsets.to_numpy()
            off = off - off[0]
            x = _floats(inner.field("vec"), width)
            u, floor, new = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("u", "floor", "new"))
            out = []
            for a, b in zip(off[:-1], off[1:], strict=True):
                if b - a < 2:
                    continue
                sim = x[a:b] @ x[a:b].T
                # Two that were both here a round ago have met.
                sim[~(new[a:b, None] | new[a:b])] = -np.inf
                sim[np.arange(b - a), np.arange(b - a)] = -np.inf
                at, s = _best(sim, OFFERED)
                ok = s > floor[a:b, None]
                out.append((np.broadcast_to(u[a:b, None], at.shape)[ok], u[a:b][at][ok], s[ok]))
            if out:
                v, w, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"v": pa.array(v), "u": pa.array(w), "sim": pa.array(s.astype(np.float32))})

    reached = 0.0
    for born in range(ROUNDS):
        floor = edges.groupBy("v").agg(F.min("sim").alias("floor"), F.count("*").alias("c")).select(F.col("v").alias("u"), F.when(F.col("c") < NEIGHBOURS, F.lit(-3e38)).otherwise(F.col("floor")).cast("float").alias("floor"))
        both = nearest(edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim", "born")), JOINED).withColumn("new", F.col("born") == born)
        # Only nodes with a neighbour that the last round brought have anything to bring together.
        both = written(both.select("v", "u", "new"), "both", 2 * rows, 200_000)
        some = both.where("new").select("v").distinct()
        about = nodes.select(F.col("node").alias("u"), "vec").join(floor, "u")
        met = both.join(some, "v", "left_semi").join(about, "u").groupBy("v").agg(F.collect_list(F.struct("u", "floor", "vec", "new")).alias("met"))
        offers = met.select("met").mapInArrow(meet, "v bigint, u bigint, sim float").withColumn("born", F.lit(born + 1))
        before, edges = edges, written(nearest(edges.unionByName(offers), NEIGHBOURS), "graph", rows, 200_000)
        discard(before)
        discard(both)
        now = edges.agg(F.sum(F.col("sim").cast("double"))).first()[0] or 0.0
        if now - reached <= SETTLED * abs(now):
            break
        reached = now
    return edges.drop("born")


def entries(near: np.ndarray) -> np.ndarray:
    """Places from which walks may start: every LAYER-th node and one node of each part of the graph."""
    n = len(near)
    v, j = np.nonzero(near >= 0)
    u = near[v, j]
    part = np.arange(n)
    while (part[v] != part[u]).any():
        least = np.minimum(part[v], part[u])
        np.minimum.at(part, part[v], least)
        np.minimum.at(part, part[u], least)
        while (part != part[part]).any():
            part = part[part]
    return np.union1d(np.arange(0, n, LAYER), part)


def walk(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, pool: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Greedy search of the graph near (rows of neighbour places, -1 for none) for the k best x by inner product with q; how many were scored."""
    seen = np.zeros(len(x) + 1, bool)
    seen[-1] = True
    at = np.unique(entry)
    seen[at] = True
    score = x[at] @ q
    scored = len(at)
    done = np.zeros(len(at), bool)
    while True:
        if len(at) > pool:
            keep = np.argpartition(-score, pool)[:pool]
            at, score, done = at[keep], score[keep], done[keep]
        left = np.flatnonzero(~done)
        if not len(left):
            break
        take = left[np.argsort(-score[left])[:16]]
        done[take] = True
        new = np.unique(near[at[take]])
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            scored += len(new)
            at, score, done = np.append(at, new), np.append(score, x[new] @ q), np.append(done, np.zeros(len(new), bool))
    best = np.argsort(-score, kind="stable")[:k]
    return at[best], score[best], scored


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, pool: int = POOL, shard: int = SHARD, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score and scored (vectors that the query was held against) of the k nearest found of each row whose key is divisible by every."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows, width = usable(vectors, key, vector)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    rows = written(rows.withColumn("node", F.xxhash64("vec")), "vectors")
    n = rows.count()
    # The k + 1 smallest ids of equal vectors are all that can be asked for.
    few = Window.partitionBy("node").orderBy("id")
    members = written(rows.select("node", "id").withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r"), "members", n)
    square = F.aggregate("vec", F.lit(0.0), lambda a, b: a + b * b)
    one = written(rows.groupBy("node").agg(F.any_value("vec").alias("vec")).withColumn("sq", square), "distinct", n, 10_000)
    total = one.agg(F.max("sq"), F.count("*")).first()
    top, k_centres = total[0], max(1, -(-total[1] // shard))
    fitted = np.zeros((1, width + 1))
    if k_centres > 1:
        some = one.orderBy(F.xxhash64("node", F.lit(3))).limit(SAMPLE).select("vec", "sq").collect()
        fitted = centres(_lifted(np.array([r["vec"] for r in some]), np.array([r["sq"] for r in some]), top), k_centres)

    def pack(batches):
        for batch in batches:
            v = _column(batch, "vec")
            y = _lifted(v.flatten().to_numpy().reshape(len(v), width), _column(batch, "sq").to_numpy(), top)
            packed = np.ascontiguousarray(y.astype(np.float32))
            size = packed.shape[1] * 4
            binary = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer((np.arange(len(y) + 1) * size).astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(nearest_centres(y, fitted, 1)[:, 0].astype(np.int32)), _column(batch, "node"), binary], names=["centre", "node", "vec"])

    placed = written(one.select("node", "vec", "sq").mapInArrow(pack, "centre int, node bigint, vec binary"), "placed")
    # A centre with too many nodes has several shards; one row a centre reaches the driver.
    sizes = {r["centre"]: r["n"] for r in placed.groupBy("centre").agg(F.count("*").alias("n")).collect()}
    parts = {c: max(1, -(-n // shard)) for c, n in sizes.items()}
    first = {c: sum(parts[d] for d in sorted(parts) if d < c) for c in parts}
    dealt = F.broadcast(spark.createDataFrame([(c, parts[c], first[c]) for c in parts], "centre int, parts int, first int"))
    shard_of = (F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))).cast("int")
    nodes = written(placed.join(dealt, "centre").select(shard_of.alias("shard"), "node", "vec"), "nodes")
    edges = graph(nodes, width + 1)
    rank = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim")).groupBy("v", "u").agg(F.max("sim").alias("sim"))
    both = both.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= 2 * NEIGHBOURS)
    adjacent = nodes.join(both.groupBy("v").agg(F.collect_list("u").alias("near")), nodes["node"] == F.col("v"), "left").select("shard", "node", "vec", "near")

    def route(batches):
        for batch in batches:
            v = _column(batch, "vec")
            y = np.column_stack([v.flatten().to_numpy().reshape(len(v), width), np.zeros(len(v))])
            near = nearest_centres(y, fitted, probes)
            rows_, shards = [], []
            for i, cs in enumerate(near.tolist()):
                found = [s for c in cs if c in parts for s in range(first[c], first[c] + parts[c])]
                rows_ += [i] * len(found)
                shards += found
            take = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *(_column(batch, c).take(take) for c in ("query", "own", "vec"))], names=["shard", "query", "own", "vec"])

    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("node").alias("own"), "vec")
    asked = written(queries.mapInArrow(route, "shard int, query bigint, own bigint, vec array<double>"), "asked")
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = asked.join(F.broadcast(load), "shard").withColumn("q", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
    index = adjacent.join(F.broadcast(load), "shard").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    want = k + 1

    def run(idx: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "own": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "scored": np.zeros(0, np.int64)})
        if not len(idx) or not len(asked):
            return empty
        node = idx["node"].to_numpy()
        order = np.argsort(node)
        node = node[order]
        x = np.frombuffer(b"".join(idx["vec"]), np.float32).reshape(len(idx), width + 1)[order]
        near = np.full((len(node), 2 * NEIGHBOURS), -1, np.int64)
        for i, j in enumerate(order):
            u = idx["near"].iat[j]
            if u is not None and len(u):
                near[i, : len(u)] = np.searchsorted(node, u)
        out = []
        layer = entries(near)
        first = x[layer]
        for query, own, vec in zip(asked["query"], asked["own"], asked["vec"], strict=True):
            q = np.append(vec, 0).astype(np.float32)
            entry = layer[_best((first @ q)[None], max(1, pool // 4))[0][0]]
            place = np.searchsorted(node, own)
            if place < len(node) and node[place] == own:
                entry = np.append(entry, place)
            at, _, scored = walk(x, near, q, entry, pool, 2 * want)
            out.append(pd.DataFrame({"query": query, "own": own, "node": node[at], "scored": scored + len(layer)}))
        return pd.concat(out) if out else empty

    found = written(asked.groupBy("shard", "q").cogroup(index.groupBy("shard", "q")).applyInPandas(lambda a, b: run(b, a), "query bigint, own bigint, node bigint, scored bigint"), "found")
    effort = found.select("query", "own", "node", "scored").groupBy("query", "own", "scored").agg(F.count("*")).groupBy("query", "own").agg(F.sum("scored").alias("scored"))
    ranked = found.drop("scored").join(members, "node").where("not (id = query and node = own)")
    to = one.select("node", F.col("vec").alias("to"))
    exact = ranked.join(to, "node").join(one.select(F.col("node").alias("own"), F.col("vec").alias("from")), "own")
    scored = exact.withColumn("score", F.aggregate(F.zip_with("from", "to", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    w = Window.partitionBy("query", "own").orderBy(F.desc("score"), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(effort, ["query", "own"])
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score", "scored")


def _lifted(x: np.ndarray, square: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, which makes all norms the largest."""
    more = np.sqrt(np.maximum(top - square, 0))
    more[more < 1e-5 * np.sqrt(top)] = 0
    return np.column_stack([x, more])
