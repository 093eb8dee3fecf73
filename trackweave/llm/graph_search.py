"""Nearest neighbours by largest inner product with robust-pruned directed graphs.

Equal vectors form one node, which keeps its ``k + 1`` smallest ids (no query
can need more, so this bound loses nothing). Nodes are dealt into shards of
bounded size by a hash; each shard is one graph, built in one task:

* Inner product becomes distance by one more coordinate, which lifts all
  vectors of the shard to the same length.
* Nodes are added in random order in growing batches. A greedy search from a few
  entries proposes neighbours; relaxed pruning keeps a near one and drops those
  that are nearer to it (times ``ALPHA``) than to the node, so that kept edges
  are diverse; reverse edges are added and pruned in the same way.
* Nodes that cannot be reached from an entry are linked at the end.

Graphs are written to the shared folder. Queries go to every shard in blocks
and are answered by beam search; the best of a shard are scored in double
precision on the original vectors, and the shards' answers are merged.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite
components, and rows without an id, take no part; vectors of different length
are not compared; equal scores go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives none. Repeated rows (id and vector) are
one, and rows of a query's own id are no candidates. Vectors keep the
precision they come in, scores are of those; an inner product beyond a double
is infinite, and one that adds both infinities ranks last. Graphs hold points
in single precision, scaled by the longest vector of their shard, so that
vectors over a million times shorter are found less surely. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.operators.keyed import join_hot
from trackweave.session import materialize

#: Edges per node, beam while building and while searching, relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
#: Nodes per shard and query vectors per block.
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Nodes at which every search begins: the middle one and the longest ones, which win many inner products.
ENTRIES = 16
#: Nodes added or queries answered at once; bounds the temporary arrays.
BATCH = 512

GRAPH = "dim int, shard int, node int, ids array<long>, vector binary, edges binary, entry boolean"
FOUND = "dim int, query long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not NULL, not zero, all components there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distance of each row's point to its candidates; all points have one length, so it falls with the product."""
    return 1.0 - np.matmul(points[ids], to[:, :, None])[:, :, 0]


class Graph:
    """A directed graph over points of length 1 (missing edges are -1)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE):
        self.points, self.degree = points, degree
        self.edges = np.full((len(points), degree), -1, np.int32)
        middle = int(np.argmax(points @ points.mean(axis=0)))
        longest = np.argsort(points[:, -1], kind="stable")[:ENTRIES - 1]  # the lifting coordinate falls with length
        self.entries = np.unique(np.append(longest, middle))

    def search(self, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beams (ids, distances; nearest first, -1 where empty) and the nodes expanded on the way."""
        n = len(to)
        ids = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        begin = 1.0 - to @ self.points[self.entries].T
        order = np.argsort(begin, axis=1)
        ids[:, :len(self.entries)] = self.entries[order]
        dist[:, :len(self.entries)] = np.take_along_axis(begin, order, axis=1)
        done = np.zeros((n, beam), bool)
        expanded = []
        active = np.arange(n)
        while len(active):
            waits = ~done[active] & (ids[active] >= 0)
            some = waits.any(axis=1)
            active, waits = active[some], waits[some]
            if not len(active):
                break
            at = waits.argmax(axis=1)
            node = ids[active, at]
            done[active, at] = True
            step = np.full(n, -1, np.int32)
            step[active] = node
            expanded.append(step)
            near = self.edges[node]
            d = distances(self.points, near, to[active])
            d[near < 0] = np.inf
            d[(near[:, :, None] == ids[active][:, None, :]).any(axis=2)] = np.inf
            d[d >= dist[active, -1][:, None]] = np.inf
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_dist = np.concatenate((dist[active], d), axis=1)
            all_done = np.concatenate((done[active], np.zeros(near.shape, bool)), axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            all_ids[~np.isfinite(all_dist)] = -1
            ids[active] = np.take_along_axis(all_ids, order, axis=1)
            dist[active] = np.take_along_axis(all_dist, order, axis=1)
            done[active] = np.take_along_axis(all_done, order, axis=1)
        return ids, dist, np.stack(expanded, axis=1) if expanded else np.full((n, 0), -1, np.int32)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Edges of each node out of its candidates: nearest first, without those that a kept one covers."""
        order = np.argsort(candidates, axis=1)
        candidates = np.take_along_axis(candidates, order, axis=1)
        drop = (candidates < 0) | (candidates == nodes[:, None])
        drop[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        own = distances(self.points, candidates, self.points[nodes])
        own[drop] = np.inf
        vectors = self.points[candidates]
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            best = own.argmin(axis=1)
            alive = np.isfinite(own[rows, best])
            if not alive.any():
                break
            kept[alive, k] = candidates[rows, best][alive]
            between = 1.0 - np.matmul(vectors, vectors[rows, best][:, :, None])[:, :, 0]
            # Distances are squares of lengths, hence the square of alpha.
            own[(alpha * alpha * between <= own) & alive[:, None]] = np.inf
            own[rows, best] = np.inf
        return kept

    def add(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        ids, _, expanded = self.search(self.points[nodes], beam)
        self.edges[nodes] = self.prune(nodes, np.concatenate((ids, expanded), axis=1), alpha)
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        found, first, counts = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(found), BATCH):
            some, at, n = found[a:a + BATCH], first[a:a + BATCH], counts[a:a + BATCH]
            extra = np.full((len(some), n.max()), -1, np.int32)
            row = np.repeat(np.arange(len(some)), n)
            column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            extra[row, column] = source[np.repeat(at, n) + column]
            both = np.concatenate((self.edges[some], extra), axis=1)
            full = (both >= 0).sum(axis=1) > self.degree
            if full.any():
                self.edges[some[full]] = self.prune(some[full], both[full], alpha)
            if not full.all():
                rest = np.take_along_axis(both[~full], np.argsort(both[~full] < 0, axis=1, kind="stable"), axis=1)
                self.edges[some[~full]] = rest[:, :self.degree]

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> Graph:
        order = np.random.default_rng(seed).permutation(len(self.points))
        at, size = 0, 1
        while at < len(order):
            self.add(order[at:at + size], beam, alpha)
            at, size = at + size, min(BATCH, max(1, size * 2), max(1, len(order) // 20 + 1))
        self.link_unreached()
        return self

    def link_unreached(self) -> None:
        """Give every node a way from an entry."""
        reached = np.zeros(len(self.points), bool)
        front = self.entries
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(self.edges[front])
                front = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
            missing = np.flatnonzero(~reached)
            if not len(missing):
                return
            some = missing[:BATCH]
            ids, _, _ = self.search(self.points[some], 2 * ENTRIES)
            front = []
            for node, near in zip(some, ids[:, 0], strict=True):
                if not (free := np.flatnonzero(self.edges[near] < 0)).size:
                    self.edges = np.pad(self.edges, ((0, 0), (0, 4)), constant_values=-1)
                    free = np.flatnonzero(self.edges[near] < 0)
                self.edges[near, free[0]] = node
                front.append(node)
            front = np.array(front)


def kept(vectors: DataFrame) -> Column:
    """The vectors as they are, where of float or double, else as double."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths in extended precision, in which no square of a double overflows."""
    return np.sqrt((vectors.astype(np.longdouble) ** 2).sum(axis=1))


def lifted(vectors: np.ndarray, longest: np.longdouble) -> np.ndarray:
    """Points of length 1 in one more dimension, ordered by distance as the vectors are by inner product."""
    scaled = (vectors / longest).astype(np.float32)
    rest = np.sqrt(np.maximum(0, 1 - (scaled.astype(np.float64) ** 2).sum(axis=1)))
    return np.concatenate((scaled, rest[:, None].astype(np.float32)), axis=1)


def stacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in column])


def build_shard(group: pd.DataFrame) -> pd.DataFrame:
    """One shard's nodes with their edges."""
    group = group.iloc[np.argsort([ids[0] for ids in group["ids"]], kind="stable")].reset_index(drop=True)
    vectors = np.stack(group["embedding"].to_list())
    graph = Graph(lifted(vectors, lengths(vectors).max())).build()
    return pd.DataFrame({
        "dim": group["dim"], "shard": group["shard"], "node": np.arange(len(group), dtype=np.int32), "ids": group["ids"],
        "vector": [v.tobytes() for v in vectors], "edges": [e.tobytes() for e in graph.edges],
        "entry": np.isin(np.arange(len(group)), graph.entries),
    })


def search_shard(k: int, beam: int):
    """Answers of one shard to one block of query vectors: per query its k + 1 best ids."""

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(graph) and len(asked):
            graph = graph.sort_values("node")
            vectors, ids = stacked(graph["vector"], int(graph["dim"].iloc[0])), graph["ids"].to_list()
            index = Graph(lifted(vectors, lengths(vectors).max()))
            index.edges = np.stack([np.frombuffer(e, np.int32) for e in graph["edges"]])
            index.entries = np.flatnonzero(graph["entry"].to_numpy())
            counts = np.array([len(x) for x in ids])
            starts = np.concatenate(([0], np.cumsum(counts)))
            flat = np.concatenate(ids)
            queries = np.stack(asked["embedding"].to_list()).astype(np.float64)
            units = queries / lengths(queries)[:, None]
            points = np.concatenate((units, np.zeros((len(queries), 1))), axis=1).astype(np.float32)
            keys = asked["query"].to_numpy()
            for a in range(0, len(queries), BATCH):
                found, _, _ = index.search(points[a:a + BATCH], beam)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.einsum("qbd,qd->qb", vectors[found].astype(np.float64), queries[a:a + BATCH])
                scores[(found < 0) | np.isnan(scores)] = -np.inf
                row, column = np.nonzero(found >= 0)
                node = found[row, column]
                n = counts[node]
                who = np.repeat(row, n)
                vec = flat[np.repeat(starts[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                score = np.repeat(scores[row, column], n)
                order = np.lexsort((vec, -score, who))
                who, vec, score = who[order], vec[order], score[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                best = rank <= k
                parts.append(pd.DataFrame({"query": keys[a:a + BATCH][who[best]], "vec_id": vec[best], "score": score[best]}))
        out = pd.concat(parts) if parts else pd.DataFrame({"query": [], "vec_id": [], "score": []})
        out.insert(0, "dim", asked["dim"].iloc[0] if len(asked) else 0)
        return out.astype({"dim": "int32", "query": "int64", "vec_id": "int64", "score": "float64"})

    return run


def build_graphs(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored graphs of all shards. ``vectors`` has vec_id and embedding (usable ones)."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = vectors.select(F.col("vec_id").cast("long"), kept(vectors).alias("embedding")).distinct().withColumn(
        "place", F.row_number().over(same)
    ).filter(F.col("place") <= k + 1)  # a limit per group goes before the shuffle: a hot vector is k + 1 rows per task
    nodes = firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn(  # one row per vector length
        "shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")
    ).drop("shards")
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(build_shard, GRAPH), "graph")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query (vec_id, embedding) but itself."""
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), kept(queries).alias("embedding")).distinct()
    queries = materialize(queries.withColumn("query", F.xxhash64("embedding")), "queries")
    # One search per distinct vector.
    asked = queries.groupBy("query", "embedding").agg(F.count("*").alias("n")).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.col("query"), F.lit(blocks)).cast("int"))
    shards = graphs.groupBy(F.col("dim").alias("dim"), F.col("shard").alias("shard")).agg(F.lit(1).alias("one"))
    each = asked.join(F.broadcast(shards), "dim").select(
        *[F.col(c).alias(c) for c in ("dim", "shard", "block", "query", "embedding")]
    )
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = copies.groupBy("dim", "shard", "block").cogroup(each.groupBy("dim", "shard", "block")).applyInPandas(
        search_shard(k, beam), FOUND
    )
    best = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    answers = ranked.groupBy("dim", "query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    joined = join_hot(queries.withColumn("dim", F.size("embedding")), answers, ["dim", "query"], "inner")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all other rows."""
    good = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return search_graphs(build_graphs(good, k), good.filter(F.col("vec_id") % every == 0), k)
