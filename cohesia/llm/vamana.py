"""Approximate nearest neighbours by a robust-pruned directed graph for each shard; every shard is asked.

A shard's graph starts from random out-links. Nodes then take turns: a greedy search from the medoid
proposes the nodes it met, pruning keeps a candidate only if no kept one is nearer to it by the factor
alpha than the node itself, and the kept ones get a link back (pruned again where a list overflows). With
alpha over one, long links survive, so that few steps lead anywhere.

Largest inner products are nearest neighbours once every vector of a shard gets one more component,
sqrt(M * M - |x| * |x|) for the shard's longest norm M: all then have the norm M.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import width
from .blocks import by_bytes, dealt, fresh, matrix, rows_of, usable
from .common import groups, saved

SHARD_ROWS, SHARD_BYTES = 32_768, 32 << 20  # of a graph's vectors, about; the smaller one counts
BLOCK_ROWS = 4096  # queries of a task, about
DEGREE = 32
PROPOSED = 2  # nearest candidates that pruning looks at, times the degree
BUILD_BEAM = 32
PASSES = (1.2,)  # alpha of each pass over the nodes
BEAM = 160
AUDIT, RECALL = 48, 0.93  # queries of a task that are also compared with the whole shard, and what they must find
WIDE = 4  # nodes that a step expands, at least
STEP = 512  # searches that advance together


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: int, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of all queries from one entry: nodes and inner products, best first (-1: none).

    The frontier of a query is its `beam` best nodes; each step expands its best ones that were not
    expanded yet, until none is left. With `visited`, the nodes expanded on the way are returned as well.
    """
    n, size = len(q), len(x)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, np.float32)
    ids[:, 0], sim[:, 0] = entry, q @ x[entry]
    done = np.ones((n, beam), bool)
    done[:, 0] = False
    met = np.zeros((n, size), bool)
    met[:, entry] = True
    trail_ids, trail_sim = [], []
    live = rows
    wide = max(WIDE, beam // 16)
    while len(live):
        # Beams are kept sorted, so the first open entries are the best ones.
        open_ = ~done[live]
        turn = open_ & (open_.cumsum(1) <= wide)
        r, c = np.nonzero(turn)
        done[live[r], c] = True
        node = ids[live[r], c]
        if visited:
            step_ids, step_sim = np.full((n, wide), -1, np.int64), np.full((n, wide), -np.inf, np.float32)
            at = np.arange(len(r)) - np.searchsorted(r, r)
            step_ids[live[r], at], step_sim[live[r], at] = node, sim[live[r], c]
            trail_ids.append(step_ids), trail_sim.append(step_sim)
        to = links[node]
        owner = np.repeat(live[r], to.shape[1])
        to = to.ravel()
        new = to >= 0
        owner, to = owner[new], to[new].astype(np.int64)
        new = ~met[owner, to]
        key = np.sort(owner[new] * size + to[new])
        key = key[fresh(key)]
        owner, to = key // size, key % size
        met[owner, to] = True
        got = np.einsum("nd,nd->n", x[to], q[owner])
        # Fresh nodes as a ragged block beside each live beam; worse than the beam's last ones drop out.
        good = got > sim[owner, -1]
        owner, to, got = owner[good], to[good], got[good]
        first = np.flatnonzero(fresh(owner))
        if len(first):
            touched, count = owner[first], np.diff(np.append(first, len(owner)))
            at = np.arange(len(owner)) - np.repeat(first, count)
            where = np.repeat(np.arange(len(touched)), count)
            all_ids = np.full((len(touched), beam + int(count.max())), -1, np.int64)
            all_sim = np.full(all_ids.shape, -np.inf, np.float32)
            all_done = np.ones(all_ids.shape, bool)
            all_ids[:, :beam], all_sim[:, :beam], all_done[:, :beam] = ids[touched], sim[touched], done[touched]
            all_ids[where, beam + at], all_sim[where, beam + at], all_done[where, beam + at] = to, got, False
            order = np.argsort(-all_sim, 1, kind="stable")[:, :beam]
            ids[touched], sim[touched], done[touched] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sim, all_done))
        live = live[(~done[live]).any(1)]
    if visited:
        return np.concatenate([ids, *trail_ids], 1), np.concatenate([sim, *trail_sim], 1)
    return ids, sim


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, alpha: float, degree: int, width: int) -> np.ndarray:
    """At most `degree` out-links of each node, in lists of `width`: candidates from the nearest on, but those to which a
    kept one is nearer by the factor alpha.

    All vectors have norm one, so the squared distance is 2 - 2 * inner product.
    """
    out = np.full((len(own), width), -1, np.int32)
    for s in range(0, len(own), 256):
        o, c, v = own[s : s + 256], cand[s : s + 256], sim[s : s + 256]
        v = np.where((c >= 0) & (c != o[:, None]), v, -np.inf)
        order = np.argsort(-v, 1, kind="stable")[:, : PROPOSED * degree]
        c, v = np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1)
        alive = v > -np.inf
        points = x[np.maximum(c, 0)]
        near = 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))
        far = 2 - 2 * v
        count = np.zeros(len(o), np.int64)
        for k in range(c.shape[1]):
            rows = np.flatnonzero(alive[:, k] & (count < degree))
            if not len(rows):
                continue
            out[s + rows, count[rows]] = c[rows, k]
            count[rows] += 1
            alive[rows] &= alpha * alpha * near[rows, k] > far[rows]
    return out


class Graph:
    """Out-links of unit vectors x, found from the medoid. Lists hold half as many links again as pruning leaves."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, seed: int = 11):
        self.x = x
        n = len(x)
        self.entry = int((x @ x.mean(0)).argmax()) if n else 0
        self.degree = max(1, min(degree, n - 1))
        rng = np.random.default_rng(seed)
        self.links = np.full((n, self.degree + self.degree // 2), -1, np.int32)
        start = max(1, self.degree // 2)
        self.links[:, :start] = rng.integers(0, max(n, 1), (n, start))
        self.links[self.links == np.arange(n)[:, None]] = -1
        for alpha in PASSES if n > 1 else ():
            turn = rng.permutation(n)
            for s in range(0, n, STEP):
                self._settle(turn[s : s + STEP], alpha)

    def _settle(self, nodes: np.ndarray, alpha: float) -> None:
        x, links = self.x, self.links
        width = links.shape[1]
        cand, sim = search(x, links, x[nodes], self.entry, BUILD_BEAM, visited=True)
        old = links[nodes]
        old_sim = np.where(old >= 0, np.einsum("nkd,nd->nk", x[np.maximum(old, 0)], x[nodes]), -np.inf)
        cand, sim = np.concatenate([cand, old], 1), np.concatenate([sim, old_sim], 1)
        # A candidate met twice counts once.
        order = np.argsort(cand, 1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        links[nodes] = prune(x, nodes, cand, sim, alpha, self.degree, width)
        src, dst = np.repeat(nodes, width), links[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        there = (links[dst] == src[:, None]).any(1)
        src, dst = src[~there], dst[~there]
        # Links back, as many for each target a round as a list may overflow by, until all are told.
        while len(src):
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            at = np.arange(len(dst)) - np.repeat(first, count)
            now = at < width
            extra = np.full((len(to), min(int(count.max()), width)), -1, np.int64)
            extra[np.repeat(np.arange(len(to)), count)[now], at[now]] = src[now]
            both = np.concatenate([links[to], extra], 1)
            room = (both >= 0).sum(1) <= width
            links[to[room]] = -np.sort(-both[room], 1)[:, :width]
            if not room.all():
                own, both = to[~room], both[~room]
                sims = np.where(both >= 0, np.einsum("nkd,nd->nk", x[np.maximum(both, 0)], x[own]), -np.inf)
                links[own] = prune(x, own, both, sims, alpha, self.degree, width)
            src, dst = src[~now], dst[~now]

    def find(self, q: np.ndarray, beam: int) -> np.ndarray:
        step = max(1, min(STEP, (1 << 24) // max(1, len(self.x))))
        return np.concatenate([search(self.x, self.links, q[s : s + step], self.entry, beam)[0] for s in range(0, len(q), step)])


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors with the component that makes all norms equal, scaled to norm one (the most similar by inner product stay so)."""
    norm = np.sqrt((v * v).sum(1))
    top = norm.max(initial=0.0) or 1.0
    return np.column_stack([v / top, np.sqrt(np.maximum(0.0, 1 - (norm / top) ** 2))]).astype(np.float32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _ask(graph: Graph, v: np.ndarray, ids: np.ndarray, node: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the k best rows found for each query; the beam doubles until the audited queries find RECALL of theirs.

    `node` says which distinct vector each row, in order of vec_id, holds; v are the distinct vectors.
    """
    unit = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
    unit = np.column_stack([unit, np.zeros(len(q))]).astype(np.float32)
    order = np.argsort(node, kind="stable")
    start = np.searchsorted(node[order], np.arange(len(v) + 1))
    # The first k + 1 ids of a vector are all of its that can be among the k first of a query.
    take = np.minimum(np.diff(start), k + 1)

    def best(rows: np.ndarray, nodes: np.ndarray):
        r, c = np.nonzero(nodes >= 0)
        who, at = rows[r], nodes[r, c]
        score = np.concatenate([inner(q[who[s : s + 65_536]], v[at[s : s + 65_536]]) for s in range(0, len(at), 65_536)] or [np.zeros(0)])
        n = take[at]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, score, vec = np.repeat(who, n), np.repeat(score, n), ids[order[np.repeat(start[at], n) + offset]]
        other = vec != q_ids[who]
        who, score, vec = who[other], score[other], vec[other]
        # The best score of an id first, then the k first of each query.
        by = np.lexsort((-score, vec, who))
        who, score, vec = who[by], score[by], vec[by]
        keep = fresh(who, vec)
        who, score, vec = who[keep], score[keep], vec[keep]
        by = np.lexsort((vec, -score, who))
        who, score, vec = who[by], score[by], vec[by]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[keep], vec[keep], score[keep]

    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    exact = unit[audit] @ graph.x.T
    m = min(len(v), 2 * k + 8)  # single precision preselects
    truth = best(audit, np.argpartition(-exact, m - 1, 1)[:, :m])
    beam = BEAM
    while True:
        found = best(np.arange(len(q)), graph.find(unit, min(beam, len(v))))
        hit = np.isin(truth[0] * np.int64(1 << 32) + np.searchsorted(np.sort(ids), truth[1]), found[0] * np.int64(1 << 32) + np.searchsorted(np.sort(ids), found[1]))
        if not len(hit) or hit.mean() >= RECALL or beam >= len(v):
            return found
        beam *= 2


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of vectors(vec_id, embedding) for each query.

    Queries are the rows whose vec_id `query_every` divides, candidates all rows but those of the query's
    vec_id. Nearness and score are the inner product of the original vectors in double precision, the
    largest first, ties by smaller vec_id. Rows with a null vec_id or a null, empty or zero vector, or a
    null or non-finite component, take no part; only vectors of one length are compared. Equal vectors are
    one node of a graph that keeps all its ids. Repeated rows count once; of different vectors with one
    vec_id a query asks with the smallest, and as a candidate the best one counts. Other columns are ignored; an
    empty table gives no rows; with fewer than k candidates all are returned.

    Every length is dealt by hash into shards of bounded bytes; each block of queries asks every shard and
    widens its beam until an audit against the whole shard finds enough; lists of k are merged by a window.
    """
    spark = by_bytes(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).where(F.exists("embedding", lambda e: e != 0))
    rows = rows.select(F.size("embedding").alias("d"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    asking = F.col("vec_id") % query_every == 0
    room = F.greatest(F.lit(64), F.least(F.lit(shard_rows), F.lit(SHARD_BYTES) / (4 * F.col("d"))))
    kinds = rows.groupBy("d").agg(F.count("d").alias("n"), F.count(F.when(asking, 1)).alias("q"))
    kinds = kinds.select("d", F.ceil(F.col("n") / room).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / block_rows)).alias("blocks"))
    kinds = saved(kinds, "kinds")  # a row for each length
    shards, blocks = [max(1, int(x or 0)) for x in kinds.select(F.sum("shards"), F.sum("blocks")).first()]
    known = rows.join(kinds, "d")
    wide = rows.schema["v"].dataType.elementType.simpleString() == "double"
    kind = "<f8" if wide else "<f4"

    def build(batches):
        for t in groups(batches, 2):
            d = t.column("d")[0].as_py()
            ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v"), d)
            keep = fresh(ids, v)
            ids, v = ids[keep], v[keep]
            v, node = np.unique(v, axis=0, return_inverse=True)
            g = Graph(lifted(v))
            yield pa.record_batch([pa.array([d], pa.int32()), t.column("shard").combine_chunks().slice(0, 1), pa.array([ids.astype("<i8").tobytes()]), pa.array([node.ravel().astype("<i4").tobytes()]), pa.array([v.astype(kind).tobytes()]), pa.array([g.links.tobytes()]), pa.array([g.entry], pa.int32())], names=["d", "shard", "ids", "node", "v", "links", "entry"])

    def pack(batches):
        for t in groups(batches, 2):
            d = t.column("d")[0].as_py()
            ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v"), d)
            keep = fresh(ids)
            yield pa.record_batch([pa.array([d], pa.int32()), t.column("block").combine_chunks().slice(0, 1), pa.array([ids[keep].astype("<i8").tobytes()]), pa.array([v[keep].astype(kind).tobytes()])], names=["d", "block", "q_ids", "q"])

    def ask(batches):
        held, g = None, None
        for row in rows_of(batches):
            d = row["d"]
            if held != (d, row["shard"]):
                held = d, row["shard"]
                v = np.frombuffer(row["v"], kind).reshape(-1, d).astype(np.float64)
                ids, node = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["node"], "<i4")
                g = Graph.__new__(Graph)
                g.x, g.entry, g.links = lifted(v), row["entry"], np.frombuffer(row["links"], np.int32).reshape(len(v), -1)
            q_ids, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q"], kind).reshape(-1, d).astype(np.float64)
            who, vec, score = _ask(g, v, ids, node, q, q_ids, k)
            yield pa.record_batch([pa.array(q_ids[who]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    graphs = known.select("d", F.pmod(F.xxhash64("vec_id"), F.col("shards")).alias("shard"), "vec_id", "v").repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", "vec_id", "v")
    graphs = saved(graphs.mapInArrow(build, "d int, shard long, ids binary, node binary, v binary, links binary, entry int"), "graphs")
    queries = known.where(asking).select("d", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).alias("block"), "vec_id", "v").repartition(blocks, "d", "block").sortWithinPartitions("d", "block", "vec_id", "v")
    queries = saved(queries.mapInArrow(pack, "d int, block long, q_ids binary, q binary"), "queries")
    tiles = dealt(graphs.join(queries.hint("shuffle_hash"), "d"), min(shards * blocks, 100 * width(spark)), "d", "shard", "block")
    found = saved(tiles.mapInArrow(ask, "query_id long, vec_id long, score double"), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a shard
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
