"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Vectors are dealt to shards by hash, about SHARD_ROWS to one; each shard's graph is built alone and kept as flat arrays: for each layer
a (nodes, M) table of neighbours, -1 where there is none. Equal vectors of a shard are one node. Nodes are inserted in
batches that grow with the graph; a batch is linked to the graph before it and within itself, and links are pruned by the
heuristic that keeps a neighbour only if it is nearer to the node than to a neighbour already kept. A search goes down the layers
greedily and runs a beam of EF on the lowest, for many queries in step. Every query is put to every shard, in blocks; the
shards' results are merged to the K nearest by cosine similarity.

Defined cases: null, empty, zero or non-finite vectors, and those whose length differs from the most common, are
neither queries nor neighbours and have empty lists; a row is not its own neighbour, but another row with an equal vector is; equal similarities are ordered by
vec_id (null last); a table of fewer than K + 1 vectors gives shorter lists; an empty table gives an empty result; rows repeated as a whole are
each a query; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import cut

K = 10
M = 16
EF = 96
BUILD_EF = 64
SHARD_ROWS = 8_192
#: Queries to a block, and blocks that are searched for by one task, in one shard.
BLOCK_ROWS = 512
BLOCKS = 64
#: Similarities that are equal when rounded, as they are shown, differ by less.
TIE = 1e-5


def _beam(vectors: np.ndarray, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best ef for each query, best first; -1 where fewer were met. entry: (queries, e) nodes."""
    nq, n = len(queries), len(vectors)
    seen = np.zeros((nq, n), bool)
    rows = np.arange(nq)[:, None]
    entry = np.where(entry < 0, entry[:, :1], entry)
    first = np.ones(entry.shape, bool)
    for j in range(1, entry.shape[1]):
        first[:, j] = (entry[:, j : j + 1] != entry[:, :j]).all(1)
    nodes = np.full((nq, ef), -1, np.int32)
    sims = np.full((nq, ef), -np.inf, np.float32)
    e = min(entry.shape[1], ef)
    nodes[:, :e] = np.where(first, entry, -1)[:, :e]
    sims[:, :e] = np.where(first[:, :e], np.einsum("qed,qd->qe", vectors[entry[:, :e]], queries), -np.inf)
    seen[rows, entry] = True
    done = nodes < 0
    live = np.arange(nq)
    width = 4
    while len(live):
        # the best open nodes of each beam are expanded together
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, min(width, ef - 1), 1)[:, :width]
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        going = good.any(1)
        live, pick, good = live[going], pick[going], good[going]
        if not len(live):
            break
        at = live[:, None]
        done[at, pick] |= good
        near = layer[np.where(good, nodes[at, pick], 0)].copy()
        near[~good] = -1
        near = near.reshape(len(live), -1)
        use = near >= 0
        use &= ~seen[at, np.where(use, near, 0)]
        near = np.where(use, near, -1)
        near.sort(1)
        use = near >= 0
        use[:, 1:] &= near[:, 1:] != near[:, :-1]
        most = int(use.sum(1).max(initial=0))
        if not most:
            continue
        q, c = np.nonzero(use)
        node = near[q, c]
        seen[live[q], node] = True
        fresh = np.einsum("nd,nd->n", vectors[node], queries[live[q]])
        col = np.cumsum(use, 1)[q, c] - 1
        new_nodes, new_sims = np.full((len(live), most), -1, np.int32), np.full((len(live), most), -np.inf, np.float32)
        new_nodes[q, col], new_sims[q, col] = node, fresh
        both, value = np.concatenate([nodes[live], new_nodes], 1), np.concatenate([sims[live], new_sims], 1)
        state = np.concatenate([done[live], new_nodes < 0], 1)
        best = np.argpartition(-value, ef - 1, 1)[:, :ef]
        nodes[live], sims[live], done[live] = (np.take_along_axis(x, best, 1) for x in (both, value, state))
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _select(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """(nodes, m): of candidates in order of falling similarity, those nearer to the node than to any kept before; filled up with the rest."""
    n, c = candidates.shape
    out = np.full((n, m), -1, np.int32)
    for lo in range(0, n, 512):
        cand, sim = candidates[lo : lo + 512], sims[lo : lo + 512]
        v = vectors[np.maximum(cand, 0)]
        among = np.einsum("ncd,ned->nce", v, v)
        kept = np.zeros(cand.shape, bool)
        number = np.zeros(len(cand), np.int64)
        for j in range(c):
            clash = (kept & (among[:, :, j] > sim[:, j : j + 1])).any(1)
            kept[:, j] = (cand[:, j] >= 0) & ~clash & (number < m)
            number += kept[:, j]
        rank = np.where(kept, np.arange(c), np.where(cand >= 0, c + np.arange(c), 3 * c))
        order = np.argsort(rank, 1)[:, :m]
        picked = np.take_along_axis(cand, order, 1)
        out[lo : lo + 512, : picked.shape[1]] = picked
    return out


def _backlinks(vectors: np.ndarray, layer: np.ndarray, node: np.ndarray, to: np.ndarray) -> None:
    """Adds links to -> node and prunes what is too long."""
    order = np.lexsort((node, to))
    node, to = node[order], to[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    if not len(target):
        return
    width = int(count.max())
    extra = np.full((len(target), width), -1, np.int32)
    col = np.arange(len(to)) - np.repeat(first, count)
    extra[np.repeat(np.arange(len(target)), count), col] = node
    m = layer.shape[1]
    for lo in range(0, len(target), 512):
        t = target[lo : lo + 512]
        cand = np.concatenate([layer[t], extra[lo : lo + 512]], 1)
        cand.sort(1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sim = np.where(cand >= 0, np.einsum("ncd,nd->nc", vectors[np.maximum(cand, 0)], vectors[t]), -np.inf)
        by = np.argsort(-sim, 1, kind="stable")[:, : 4 * m]
        layer[t] = _select(vectors, np.take_along_axis(cand, by, 1), np.take_along_axis(sim, by, 1), m)


class Graph:
    """vectors: (n, d) unit vectors, distinct; layers: flat neighbour arrays, the lowest first, of node numbers."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = BUILD_EF, seed: int = 1):
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the nodes of the upper layers come first
        self.vectors = np.ascontiguousarray(vectors[order], np.float32)
        self.original = order
        level = level[order]
        self.layers = []
        for l in range(int(level.max(initial=0)) + 1):
            here = int((level >= l).sum())
            self.layers.append(np.full((here, 2 * m if l == 0 else m), -1, np.int32))
        top = len(self.layers) - 1
        for l in range(top, -1, -1):
            layer = self.layers[l]
            start = len(self.layers[l + 1]) if l < top else 0
            # nodes of the layer above are linked here first, from its links; then the rest in growing batches
            at = 0
            while at < len(layer):
                size = max(1, min(1024, at // 2 or 1))
                if at == 0:
                    size = min(len(layer), 32)
                end = min(len(layer), at + size)
                self._insert(l, at, end, ef)
                at = end
            del start

    def _insert(self, l: int, lo: int, hi: int, ef: int) -> None:
        layer, v = self.layers[l], self.vectors
        q = v[lo:hi]
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        own = min(len(q) - 1, layer.shape[1])
        near = np.argsort(-inside, 1, kind="stable")[:, :own]
        nodes, sims = (near + lo).astype(np.int32), np.take_along_axis(inside, near, 1)
        if lo:
            entry = self._descend(q, l, lo)
            found, value = _beam(v[:lo], layer[:lo], q, entry, min(ef, max(lo, 1)))
            nodes, sims = np.concatenate([found, nodes], 1), np.concatenate([value, sims.astype(np.float32)], 1)
        order = np.argsort(-sims, 1, kind="stable")
        nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        if not nodes.shape[1]:
            return
        layer[lo:hi] = _select(v, nodes, sims, layer.shape[1])
        a = np.repeat(np.arange(lo, hi), layer.shape[1])
        b = layer[lo:hi].ravel()
        _backlinks(v, layer, a[b >= 0].astype(np.int32), b[b >= 0].astype(np.int32))

    def _descend(self, q: np.ndarray, l: int, least: int) -> np.ndarray:
        """Entries for layer l: the best few of the layers above, all below `least` where that layer is still being filled."""
        entry = np.zeros((len(q), 1), np.int32)
        for k in range(len(self.layers) - 1, l, -1):
            size = min(len(self.layers[k]), least)
            layer = self.layers[k][:size]
            layer = np.where(layer < size, layer, -1)
            entry, _ = _beam(self.vectors[:size], layer, q, entry, min(8, size))
        return entry

    def search(self, q: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        """(nodes by their number in the input, similarities), best first; -1 where there are fewer."""
        ef = max(1, min(max(ef, k), len(self.vectors)))
        ids, sims = [], []
        for lo in range(0, len(q), 512):
            part = np.ascontiguousarray(q[lo : lo + 512], np.float32)
            nodes, value = _beam(self.vectors, self.layers[0], part, self._descend(part, 0, len(self.vectors)), ef)
            ids.append(np.where(nodes >= 0, self.original[np.maximum(nodes, 0)], -1)[:, :k])
            sims.append(value[:, :k])
        return np.concatenate(ids), np.concatenate(sims)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


_GRAPH = "shard int, dim int, vectors binary, ids binary, names binary, nulls binary, edges binary, original binary, shapes array<int>, layers binary"


def _build(table: pa.Table) -> pa.Table:
    """One row: a shard's distinct vectors, the rows that share each, by vec_id (null last), and its graph."""
    by = np.argsort(table["row"].to_numpy(), kind="stable")
    v = _matrix(table["v"].combine_chunks())[by]
    key = table["row"].to_numpy()[by]
    null, name = np.asarray(table["vec_id"].is_null())[by], table["vec_id"].fill_null(0).to_numpy()[by]
    distinct, inverse = np.unique(v, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.lexsort((key, name, null, inverse))
    edges = np.searchsorted(inverse[order], np.arange(len(distinct) + 1))
    g = Graph(distinct)
    row = {
        "shard": table["shard"][0].as_py(), "dim": distinct.shape[1], "vectors": g.vectors.tobytes(), "ids": key[order].tobytes(), "names": name[order].tobytes(), "nulls": null[order].tobytes(), "edges": edges.astype(np.int64).tobytes(),
        "original": g.original.astype(np.int32).tobytes(), "shapes": [x for layer in g.layers for x in layer.shape], "layers": b"".join(layer.tobytes() for layer in g.layers),
    }
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int32()), pa.binary())
    return pa.table({k: pa.array([x], t) for (k, x), t in zip(row.items(), kinds, strict=True)})


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    g = Graph.__new__(Graph)
    g.vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
    g.original = np.frombuffer(row["original"], np.int32)
    shapes, at, g.layers = row["shapes"], 0, []
    for a, b in zip(shapes[::2], shapes[1::2], strict=True):
        g.layers.append(np.frombuffer(row["layers"], np.int32, a * b, at).reshape(a, b))
        at += 4 * a * b
    return g, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["names"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["edges"], np.int64)


_MET = "row bigint, other bigint, vec_id bigint, sim double"


def _search(k: int, ef: int):
    """Blocks of queries against one shard: each query's best k + 1 rows of the shard and all that tie with the last:
    of rows with one vector the first k + 1 by vec_id, of vectors those among the ef that the search holds.
    """

    def block(graph, queries: bytes, query_ids: bytes) -> pa.Table:
        g, ids, names, nulls, edges = graph
        rows = np.frombuffer(query_ids, np.int64)
        nodes, sims = g.search(np.frombuffer(queries, np.float32).reshape(len(rows), -1), max(k + 1, ef), ef)
        use = nodes >= 0
        who, node, sim = np.nonzero(use)[0], nodes[use], sims[use]
        # a node stands for all rows with its vector; once k + 1 rows are reached, later nodes add none, but those that tie
        size = np.diff(edges)[node]
        total = np.cumsum(size)
        start = np.concatenate([[0], total])[np.searchsorted(who, np.arange(len(rows)))]
        need = total - size - start[who] < k + 1
        least = np.full(len(rows), np.inf)
        np.minimum.at(least, who[need], sim[need])
        keep = sim >= least[who] - TIE
        who, node, sim, size = who[keep], node[keep], sim[keep], np.minimum(size[keep], k + 1)
        a = np.repeat(np.arange(len(node)), size)
        at = edges[node[a]] + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        other = ids[at] != rows[who[a]]
        a, at = a[other], at[other]
        return pa.table({"row": pa.array(rows[who[a]]), "other": pa.array(ids[at]), "vec_id": pa.array(names[at], pa.int64(), mask=nulls[at]), "sim": pa.array(sim[a].astype(np.float64))})

    def of(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        none = pa.table({"row": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        if not graphs.num_rows:
            return none
        graph = _load(graphs.slice(0, 1).to_pylist()[0])
        return pa.concat_tables([none, *(block(graph, q.as_py(), i.as_py()) for q, i in zip(asked["queries"], asked["query_ids"], strict=True))])

    return of


def knn(vectors: DataFrame, k: int = K, ef: int = EF, shard_rows: int = SHARD_ROWS, asked: Column | None = None) -> DataFrame:
    """(vec_id, neighbours, similarities): for each row for which asked is true (by default all), the vec_ids of its k nearest other
    rows of all, nearest first.
    """
    emb = F.col("embedding")
    told = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    keyed = cut(
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), emb.cast("array<float>").alias("embedding"), told.alias("told")).withColumn("row", F.monotonically_increasing_id())
    )
    ok = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e30)) & F.exists("embedding", lambda x: x != 0)
    good = keyed.where(F.coalesce(ok, F.lit(False)))
    common = good.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("told").cast("bigint")).alias("told")).orderBy(F.desc("count"), "n").first()
    n, dim, queries = (common["count"], common["n"], common["told"]) if common else (0, 0, 0)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = good.where(F.size("embedding") == dim).withColumn("norm", norm).where("norm > 0").select("row", "vec_id", "told", F.transform("embedding", lambda x: (x / F.col("norm")).cast("float")).alias("v"))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // BLOCK_ROWS))
    parts = -(-blocks // BLOCKS)
    graphs = cut(unit.select("row", "vec_id", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")).repartition(shards, "shard").groupBy("shard").applyInArrow(_build, _GRAPH))

    def block(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"].combine_chunks())
        return pa.table({"b": table["b"][:1], "queries": pa.array([v.tobytes()], pa.binary()), "query_ids": pa.array([table["row"].to_numpy().tobytes()], pa.binary())})

    rows = unit.where("told").select("row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"))
    packed = cut(rows.groupBy("b").applyInArrow(block, "b int, queries binary, query_ids binary"))
    # a task holds one graph and BLOCKS blocks of queries
    sent = packed.select("queries", "query_ids", F.pmod("b", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = sent.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(_search(k, ef), _MET)
    best = met.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("sim", 5)).alias("s"), F.col("vec_id").isNull().alias("z"), F.col("vec_id").alias("v"), "other"))), 1, k).alias("x"))
    out = keyed.where("told").select("row", "vec_id").join(best, "row", "left")
    none = F.array()
    return out.select(
        "vec_id", F.coalesce(F.transform("x", lambda y: y["v"]), none.cast("array<bigint>")).alias("neighbours"), F.coalesce(F.transform("x", lambda y: -y["s"]), none.cast("array<double>")).alias("similarities")
    )
