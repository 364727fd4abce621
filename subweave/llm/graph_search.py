"""Nearest neighbours by cosine over a robust-pruned directed graph for each shard of the vectors.

A shard's graph grows in batches: greedy beam searches from the entry propose neighbours of the new nodes, pruning with
a relaxed distance keeps diverse ones, and reverse edges are pruned the same way. A query's beam search runs in
every shard; what it finds is scored exactly, in double precision, and the best over all shards are kept.
Equal vectors are one node, so a vector that very many rows hold doesn't fill the graph. Shards grow with the square root
of the number of vectors: a search reads a share of a shard that falls with its size, and there are fewer to search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.llm.shared import column, partitions, written


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities (queries x beam, best first; -1 and -inf where fewer) that beam searches from the entry find, all queries at once.

    x: normalised vectors; edges: nodes x degree, -1 where fewer; wide: nodes expanded in a step.
    """
    b = len(queries)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, queries @ x[entry], False
    seen = np.zeros((b, len(x)), bool)
    seen[:, entry] = True
    active = np.arange(b)
    while len(active):
        rank = np.where(done[active], -np.inf, sims[active])
        take = np.argpartition(-rank, wide - 1, axis=1)[:, :wide] if beam > wide else np.tile(np.arange(beam), (len(active), 1))
        fresh = np.take_along_axis(rank, take, 1) > -np.inf
        nodes = np.where(fresh, np.take_along_axis(ids[active], take, 1), -1)
        rows = active[:, None]
        done[rows, take] = True
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        near[(near >= 0) & seen[rows, near]] = -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        real = near >= 0
        seen[np.repeat(active, real.sum(1)), near[real]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[real] = np.einsum("ij,ij->i", x[near[real]], queries[np.repeat(active, real.sum(1))])
        every = np.concatenate([sims[active], new], axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        sims[active] = np.take_along_axis(every, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~real], axis=1), order, 1)
        active = active[(~done[active]).any(1)]
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node at most `degree` of its candidates (-1 where none): the nearest first, passing over those to which a chosen one is nearer, by the factor relax, than the node is."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    y = x[candidates]
    far = np.where(candidates >= 0, 2 - 2 * np.einsum("bkd,bd->bk", y, x[nodes]), np.inf)
    between = 2 - 2 * np.matmul(y, y.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = far.argmin(1)
        some = far[rows, best] < np.inf
        if not some.any():
            break
        out[some, k] = candidates[rows[some], best[some]]
        covered = relax * relax * np.maximum(between[rows, best], 0) <= far
        far[some] = np.where(covered[some], np.inf, far[some])
        far[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = 40, beam: int = 96, relax: float = 1.08, seed: int = 11) -> tuple[np.ndarray, int]:
    """Edges (nodes x degree, -1 where fewer) and the entry of the graph over normalised vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    lo = 1
    while lo < n:
        hi = min(n, lo + max(1, min(lo, 512)))
        batch = order[lo:hi]
        found, _ = beam_search(x, edges, entry, x[batch], beam)
        edges[batch] = robust_prune(x, batch, found, degree, relax)
        source = np.repeat(batch, degree)
        target = edges[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for cut in range(0, len(nodes), 256):
            own, at, c = nodes[cut : cut + 256], first[cut : cut + 256], count[cut : cut + 256]
            width = int(c.max())
            incoming = np.full((len(own), width), -1, np.int64)
            k = np.arange(width)[None, :] < c[:, None]
            incoming[k] = source[(at[:, None] + np.arange(width)[None, :])[k]]
            every = np.concatenate([edges[own], incoming], axis=1)
            size = (every >= 0).sum(1)
            room = size <= degree
            packed = -np.sort(-every, axis=1)
            edges[own[room]] = packed[room][:, :degree]
            if (~room).any():
                edges[own[~room]] = robust_prune(x, own[~room], every[~room], degree, relax)
        lo = hi
    return edges, entry


def _normalised(v: np.ndarray) -> np.ndarray:
    """In single precision, scaled first so that very large and very small components don't overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: exact, and squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build(degree: int, beam: int, relax: float):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = _normalised(_matrix(table.column("vector"), dim))
        edges, entry = build_graph(x, degree, beam, relax)
        first = np.zeros(len(x), bool)
        first[entry] = True
        bounds = np.arange(0, edges.size + 1, degree, dtype=np.int32)
        extra = [pa.array(np.arange(len(x)), pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(edges.reshape(-1), pa.int32())), pa.array(first)]
        return pa.table([table.column("dim"), table.column("shard"), *extra, table.column("ids"), table.column("vector")], names=["dim", "shard", "node", "edges", "entry", "ids", "vector"])

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, growth: float = 64, degree: int = 40, beam: int = 96, relax: float = 1.08) -> DataFrame:
    """The index as a written table: dim, shard, node, edges, entry, ids (the k + 1 smallest of the rows with this vector), vector.

    Vectors are dealt to shards by hash: about growth * sqrt(n) of n distinct ones to each, so sqrt(n) / growth shards, and more where
    a shard would hold more than 2 ** 26 components, which a task has in memory. Rows with a null id and vectors that are null, empty, zero or hold null
    or non-finite components are left out; equal vectors are one node; rows repeated as a whole count once.
    """
    ranked = usable_vectors(vectors, id_col, vector_col).distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = written(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    dims = nodes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.greatest(F.sqrt("n") / growth, F.col("n") * F.col("dim") / 2**26)).alias("shards"))
    nodes = nodes.withColumn("dim", F.size("vector")).join(dims, "dim")
    nodes = nodes.select("dim", F.pmod(F.xxhash64("vector"), "shards").cast("int").alias("shard"), "ids", "vector")
    spark = vectors.sparkSession
    kind = nodes.schema["vector"].dataType.simpleString()
    graph = nodes.repartition(partitions(spark), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build(degree, beam, relax), f"dim int, shard int, node int, edges array<int>, entry boolean, ids array<long>, vector {kind}")
    return written(graph, "graph")


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda c: c != 0))


def _search(k: int, effort: float):
    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if nodes.num_rows and queries.num_rows:
            dim = nodes.column("dim")[0].as_py()
            order = np.argsort(nodes.column("node").to_numpy())
            raw = _matrix(nodes.column("vector"), dim)[order]
            degree = len(nodes.column("edges")[0])
            edges = _matrix(nodes.column("edges"), degree)[order].astype(np.int64)
            entry = int(np.flatnonzero(nodes.column("entry").to_numpy(zero_copy_only=False)[order])[0])
            ids = [nodes.column("ids")[int(i)].as_py() for i in order]
            x, wanted = _normalised(raw), _matrix(queries.column("vector"), dim)
            names = queries.column("id").to_pylist()
            q = _normalised(wanted)
            beam = max(4 * k, int(effort * len(x) ** 0.5))
            step = max(16, min(512, (1 << 25) // len(x)))  # a search marks the nodes it has seen: step x nodes bytes
            for lo in range(0, len(q), step):
                near = beam_search(x, edges, entry, q[lo : lo + step], beam)[0]
                for i, row in enumerate(near):
                    row = row[row >= 0]
                    score = cosines(raw[row], np.broadcast_to(wanted[lo + i], (len(row), dim)))
                    own = names[lo + i]
                    best = sorted((-s, v) for s, node in zip(score.tolist(), row.tolist(), strict=True) for v in ids[node] if v != own)[:k]
                    found += [(own, v, -s) for s, v in best]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, effort: float = 0.5, block: int = 65_536) -> DataFrame:
    """The k nearest rows of each query by cosine, its own id excepted: query_id, rank int from 1, vec_id, score double.

    Ties go to the smaller id; fewer rows where the index holds fewer candidates. Unusable queries (see build_index) and those of a
    dimension that the index doesn't hold give no rows; the vectors of queries with the same id are searched together, each row
    by the nearest of them. A search keeps a beam of effort * sqrt(nodes of the shard) nodes (4 * k at least). A shard's task takes about `block` queries, a few hundred at a time; the index is dealt once for every block.
    """
    asked = written(usable_vectors(queries, id_col, vector_col).distinct(), "queries")
    blocks = max(1, -(-asked.count() // block))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.withColumn("dim", F.size("vector")).join(shards, "dim").select("id", "vector", "dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k, effort), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
