"""Approximate nearest neighbours by a robust-pruned directed graph.

Rows are dealt over shards. In each shard a graph is built in batches: greedy searches from the medoid propose neighbours,
relaxed distance pruning keeps edges in diverse directions, and edges are mirrored and pruned again. A query runs a beam
search in every shard; the shards' finds are scored anew in double precision and merged. Largest inner product becomes
smallest distance by one more coordinate, ``sqrt(M^2 - |x|^2)`` for the largest norm M.

Equal vectors are one node of the graph that knows the ``k + 1`` smallest of its ids, all that any answer can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Edges of a node, candidates held while building and when a search begins (at least; the root of a shard's rows), factor of the pruning, rows of a shard at most.
DEGREE, BUILD_BEAM, BEAM, RELAX, SHARD_ROWS = 32, 72, 96, 1.2, 200_000
#: Widest beam, in roots of a shard's rows.
WIDEST = 16


_NONE = np.uint64(2**64 - 1)


def _keys(dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distances and nodes as whole numbers that sort nearest first; the last bit is free to mark nodes whose edges were followed."""
    bits = (dist + np.float32(0)).view(np.uint32)
    order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return order.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64) << np.uint64(1)


def _nodes(keys: np.ndarray) -> np.ndarray:
    """The nodes of keys, -1 where there is none."""
    return np.where(keys == _NONE, -1, (keys >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)).astype(np.int32)


def _place(row: np.ndarray) -> np.ndarray:
    """How many entries before each are of the same row; rows ascend."""
    return np.arange(len(row)) - np.searchsorted(row, row)


class Beam:
    """A search under way, one row for each of ``q``: the pool of nearest nodes met and which nodes were seen."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray):
        self.x, self.graph, self.q = x, graph, q
        self.seen = np.zeros((len(q), len(x)), bool)
        self.seen[:, start] = True
        self.pool = _keys(-(q @ x[start]), np.full(len(q), start))[:, None]

    def run(self, rows: np.ndarray, beam: int, keep: int, width: int = 12) -> np.ndarray:
        """Follow the edges of the ``width`` nearest open nodes at a time till the ``beam`` nearest are followed; the pool then holds
        the ``keep`` nearest, so that a wider beam can go on from there."""
        n, live = len(self.x), rows
        if self.pool.shape[1] < keep:
            self.pool = np.hstack((self.pool, np.full((len(self.pool), keep - self.pool.shape[1]), _NONE)))
        while True:
            pool = self.pool[live]
            r, c = np.nonzero(pool[:, :beam] & np.uint64(1) == 0)
            first = _place(r) < width
            r, c = r[first], c[first]
            if not len(r):
                return rows
            some = np.flatnonzero(np.bincount(r, minlength=len(live)))
            if len(some) < len(live):
                r, live, pool = np.searchsorted(some, r), live[some], pool[some]
            near = self.graph[_nodes(pool[r, c])]
            pool[r, c] |= np.uint64(1)
            at, edge = np.nonzero(near >= 0)
            v, r = near[at, edge], r[at]
            fresh = ~self.seen[live[r], v]
            key = np.sort(r[fresh] * n + v[fresh])
            key = key[np.diff(key, prepend=-1) > 0]  # a node proposed twice in a step counts once
            r = key // n
            v = key - r * n
            self.seen[live[r], v] = True
            place = _place(r)
            more = np.full((len(live), int(place.max(initial=-1)) + 1), _NONE)
            more[r, place] = _keys(-np.einsum("ij,ij->i", self.q[live[r]], self.x[v]), v)
            pool = np.hstack((pool, more))
            pool.sort(1)
            self.pool[live] = pool[:, : self.pool.shape[1]]


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> np.ndarray:
    """For each row of ``q`` the ``beam`` nodes of largest inner product met, nearest first (-1: fewer)."""
    search = Beam(x, graph, start, q)
    search.run(np.arange(len(q)), beam, beam)
    return _nodes(search.pool)


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, relax: float, square: float) -> np.ndarray:
    """Of each node's pool (-1: none) keep the nearest, drop what is nearer to it by ``relax`` than to the node, and so on."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    order = np.sort(pool, 1)
    dup = np.zeros(pool.shape, bool)
    dup[:, 1:] = order[:, 1:] == order[:, :-1]
    pool = np.where(dup, -1, order)
    there = pool >= 0
    p = x[pool]
    to_node = 2 * square - 2 * np.einsum("bpd,bd->bp", p, x[nodes])
    between = 2 * square - 2 * np.matmul(p, p.transpose(0, 2, 1))
    to_node[~there] = np.inf
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmin(to_node, 1)
        ok = np.isfinite(to_node[rows, best])
        if not ok.any():
            break
        out[ok, k] = pool[rows[ok], best[ok]]
        drop = relax * between[rows, best] <= to_node
        to_node[drop & ok[:, None]] = np.inf
        to_node[rows[ok], best[ok]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 7) -> tuple[np.ndarray, int]:
    """Graph (n x degree, -1: no edge) and start node of unit-augmented rows ``x``.

    While it is built a node has room for twice as many edges, and is pruned only when mirrored ones no longer fit.
    """
    n = len(x)
    square = float((x[0] * x[0]).sum()) if n else 0.0
    rng = np.random.default_rng(seed)
    graph = np.full((n, 2 * degree), -1, np.int32)
    if n > 1:
        graph[:, : min(8, degree)] = rng.integers(0, n, (n, min(8, degree)))
    start = int(np.argmax(x @ x.mean(0))) if n else 0
    size = max(16, min(512, (1 << 26) // max(n, 1)))

    def prune(nodes: np.ndarray, pool: np.ndarray) -> None:
        for s in range(0, len(nodes), 256):
            some = nodes[s : s + 256]
            graph[some, :degree] = robust_prune(x, some, pool[s : s + 256], degree, relax, square)
        graph[nodes, degree:] = -1

    for part in np.array_split(rng.permutation(n), -(-n // size)) if n > 1 else ():
        prune(part, np.hstack((beam_search(x, graph, start, x[part], beam), graph[part])))
        r, c = np.nonzero(graph[part] >= 0)
        to, of = graph[part[r], c], part[r]
        there = (graph[to] == of[:, None]).any(1)
        to, of = to[~there], of[~there]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        while len(to):  # mirrored edges, as many of a node as fit
            used = (graph[to] >= 0).sum(1)
            nth = used + _place(to)
            fits = nth < 2 * degree
            graph[to[fits], nth[fits]] = of[fits]
            to, of = to[~fits], of[~fits]
            full = np.unique(to)
            prune(full, graph[full])
    over = np.flatnonzero((graph[:, degree:] >= 0).any(1))
    prune(over, graph[over])
    return np.ascontiguousarray(graph[:, :degree]), start


def settled_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, k: int, beam: int, settle: int | None = None) -> np.ndarray:
    """For each row of ``q`` the ``k`` nearest nodes met (-1: fewer), by beams twice as wide each time until the first ``settle`` of
    them (all, if None) stay the same, or the beam holds WIDEST times the root of the rows."""
    search, left, before, beam = Beam(x, graph, start, q), np.arange(len(q)), None, max(beam, k)
    while len(left):
        search.run(left, beam, 2 * beam)
        found = np.sort(search.pool[left, :settle or k] | np.uint64(1), 1)
        if 2 * beam > max(WIDEST * len(x) ** 0.5, 4 * k):
            break
        moved = np.ones(len(left), bool) if before is None else (found != before).any(1)
        left, before, beam = left[moved], found[moved], 2 * beam
    return _nodes(search.pool[:, :k])


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack((v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None])).astype(np.float32)


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: not null, not zero, all components finite, of the commonest length."""
    fine = F.expr("size(embedding) > 0 AND forall(embedding, x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false)) AND exists(embedding, x -> x != 0)")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(fine & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("embedding") == (common[0]["n"] if common else 0))


def _tasks(groups: int) -> int:
    """Partitions for so many heavy groups: by bytes they'd seem few and share tasks, and few partitions hash some together."""
    return 8 * groups if groups <= 64 else max(512, groups)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS, query_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows found by inner product, its own row left out.

    ``queries`` holds query_id and embedding. Rows repeated with id and vector count once. Vectors that are null, zero, or
    hold a null or non-finite component take no part, as row or query; ties go to the smaller vec_id; a query without
    candidates, or an empty table, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    by = Window.partitionBy("embedding").orderBy("vec_id")
    least = usable(vectors).distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    nodes = durable(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.col("ids")[0]), "nodes")
    ask = durable(usable(queries.withColumnRenamed("query_id", "vec_id")).withColumnRenamed("vec_id", "query_id"), "queries")
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")).alias("top")).first()
    blocks = max(1, -(-ask.count() // query_rows))
    shards, top = max(6, -(-facts["n"] // shard_rows)), facts["top"] or 0.0
    share = (k + 1) / shards
    settle = min(k + 1, math.ceil(share + 3 * share**0.5))  # rows are dealt by a hash, so hardly ever does one shard hold more of the nearest

    def index(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        v = _matrix(t["embedding"])
        graph, start = build(augmented(v, top))
        return pa.table({"shard": t["shard"][:1], "size": pa.array([len(v)], pa.int64()), "start": pa.array([start], pa.int64()), "nodes": pa.array([t["node"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary())})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).select("shard", "node", "embedding")
    built = durable(dealt.repartition(_tasks(shards), "shard").groupBy("shard").applyInArrow(index, "shard int, size long, start long, nodes binary, vectors binary, graph binary"), "index")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        row = {c: left[c][0].as_py() for c in ("size", "start", "nodes", "vectors", "graph")}
        n = row["size"]
        v = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        ids, graph = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["graph"], np.int32).reshape(n, -1)
        x, q, who = augmented(v, top), _matrix(right["embedding"]), right["query_id"].to_numpy()
        if q.shape[1] != v.shape[1]:
            return none
        size, out = max(16, min(512, (1 << 26) // n)), []
        for s in range(0, len(q), size):
            some = q[s : s + size]
            found = settled_search(x, graph, row["start"], np.hstack((some, np.zeros((len(some), 1)))).astype(np.float32), k + 1, max(beam, int(n**0.5)), settle)
            r, c = np.nonzero(found >= 0)
            f = found[r, c]
            out.append((who[s + r], ids[f], np.einsum("ij,ij->i", some[r], v[f])))
        return pa.table({c: pa.array(np.concatenate(a)) for c, a in zip(("query_id", "node", "score"), zip(*out))})

    each = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = ask.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    each, asked = (t.repartition(_tasks(shards * blocks), "shard", "block") for t in (each, asked))
    found = each.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query_id long, node long, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    best = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)  # of k + 1 nodes, at most one is the query's own alone
    rows = best.join(nodes.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id != vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
