"""Distance joins on a bucket grid; pairs are only formed inside neighbouring buckets."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import salted
from ..plans.lineage import cut

G = "graph_id"
TILE = 8  # buckets along a side of a tile of the nearest-neighbour search
TILE_QUERIES = 20_000  # queries of a tile in one task
MATRIX = 2_000_000  # distances held at a time


def _gap2(dims, a: str, b: str) -> Column:
    return reduce(lambda s, t: s + t, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in dims])


def _near(dims) -> Column:
    """All 3^d buckets around a row's own (k<c> columns)."""
    return F.explode(F.array(*[F.struct(*[(F.col(f"k{c}") + o).alias(f"k{c}") for c, o in zip(dims, off)]) for off in product((-1, 0, 1), repeat=len(dims))]))


def radius_pairs(nodes: DataFrame, r, dims=("x", "y")) -> DataFrame:
    """(graph_id, src<dst, length) for node pairs at distance <= r; r is a number or a column of nodes."""
    rc = r if isinstance(r, Column) else F.lit(float(r))
    p = nodes.select(G, "node_id", *dims, rc.alias("r"))
    p = p.withColumns({f"k{c}": F.floor(F.col(c) / F.col("r")) for c in dims})
    left = p.select(G, F.col("node_id").alias("src"), "r", *[F.col(c).alias(f"s{c}") for c in dims], _near(dims).alias("k")).select("*", "k.*").drop("k")
    right = p.select(G, F.col("node_id").alias("dst"), *[F.col(c).alias(f"d{c}") for c in dims], *[f"k{c}" for c in dims])
    j = salted(left, right, [G, *[f"k{c}" for c in dims]], ["src"]).where("src < dst")
    d2 = _gap2(dims, "s", "d")
    return j.where(F.sqrt(d2) <= F.col("r")).select(G, "src", "dst", F.sqrt(d2).alias("length"))


def radius_graph(nodes: DataFrame, r, dims=("x", "y"), fallback_k: int = 5) -> DataFrame:
    """Undirected radius graph; a graph without any pair gets its k-nearest-neighbour edges instead."""
    pairs = cut(radius_pairs(nodes, r, dims).select(G, "src", "dst"))
    bare = nodes.join(pairs.select(G).distinct(), G, "left_anti")
    if bare.limit(1).count() == 0:
        return pairs
    return pairs.union(knn_edges(bare, fallback_k, dims))


def _nearest(dims, k: int, skip_self: bool):
    """Top k of a tile: each query against the points in the 3^d buckets around its own."""

    def solve(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node_id", kind="stable")
        h = q["h"].iloc[0]
        at, points = q[[f"q{c}" for c in dims]].to_numpy(), p[[f"p{c}" for c in dims]].to_numpy()
        mine, theirs = np.floor(at / h).astype(np.int64), np.floor(points / h).astype(np.int64)
        low = np.minimum(mine.min(0), theirs.min(0, initial=np.iinfo(np.int64).max)) - 1
        shape = np.maximum(mine.max(0), theirs.max(0, initial=np.iinfo(np.int64).min)) - low + 2
        steps = np.append(np.cumprod(shape[:0:-1])[::-1], 1)
        mine, theirs = (mine - low) @ steps, (theirs - low) @ steps
        by = np.argsort(theirs, kind="stable")
        sorted_cells = theirs[by]
        rows = np.argsort(mine, kind="stable")
        ends = np.flatnonzero(np.append(mine[rows][1:] != mine[rows][:-1], True)) + 1
        ids, own = p["node_id"].to_numpy(), q["qid"].to_numpy()
        around = np.array(list(product((-1, 0, 1), repeat=len(dims) - 1)), np.int64).reshape(-1, len(dims) - 1) @ steps[:-1]
        out = []
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            cell = mine[rows[lo]] + around
            first, last = np.searchsorted(sorted_cells, cell - 1, "left"), np.searchsorted(sorted_cells, cell + 1, "right")
            near = np.sort(np.concatenate([by[i:j] for i, j in zip(first, last)]))  # in the order of node_id
            if not len(near):
                continue
            step = max(1, MATRIX // len(near))
            for i in range(lo, hi, step):
                r = rows[i : min(i + step, hi)]
                gap = 0.0
                for d in range(len(dims)):
                    one = at[r, d][:, None] - points[near, d][None, :]
                    gap = gap + one * one
                dist = np.sqrt(gap)
                if skip_self:
                    dist[own[r][:, None] == ids[near][None, :]] = np.inf
                bound = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(near) > k else np.full(len(r), np.inf)
                a, b = np.nonzero((dist <= bound[:, None]) & (dist < np.inf))
                order = np.lexsort((b, dist[a, b], a))
                a, b = a[order], b[order]
                start = np.searchsorted(a, np.arange(len(r)))
                rank = np.arange(len(a)) - start[a]
                a, b, rank = a[rank < k], b[rank < k], rank[rank < k]
                d, count = dist[a, b], np.bincount(a, minlength=len(r))
                far = np.zeros(len(r))
                np.maximum.at(far, a, d)
                ok = ((count >= q["want"].to_numpy()[r]) & (far <= h)) | (h >= q["span"].to_numpy()[r])
                keep = ok[a]
                out.append((r[a[keep]], near[b[keep]], rank[keep] + 1, d[keep]))
        r, n, rank, d = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], np.int64)] * 4
        return pd.DataFrame({G: q[G].iloc[0], "qid": own[r], "rank": rank.astype(np.int32), "node_id": ids[n], "dist": d.astype(float)})

    return solve


def knn(queries: DataFrame, nodes: DataFrame, k: int, dims=("x", "y"), skip_self: bool = False) -> DataFrame:
    """Exact k nearest nodes of each query(graph_id, qid, dims): (graph_id, qid, rank, node_id, dist), ties by node id.

    Each round searches the 3^d buckets around the pending queries. A query is settled once its
    k-th hit lies within one bucket width, which the search is sure to cover; the rest retry with
    buckets twice as wide, until one bucket ring covers everything. Buckets are dealt in tiles of TILE
    a side, to which nodes of the ring around a tile are copied; pairs never leave the task of a tile.
    """
    box = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"l{c}") for c in dims], *[F.max(c).alias(f"h{c}") for c in dims])
    qbox = queries.groupBy(G).agg(*[F.min(c).alias(f"ql{c}") for c in dims], *[F.max(c).alias(f"qh{c}") for c in dims])
    span = F.greatest(*[F.greatest(f"h{c}", f"qh{c}") - F.least(f"l{c}", f"ql{c}") for c in dims], F.lit(1e-12))
    grid = cut(box.join(qbox, G).select(G, span.alias("span"), (span * F.pow(F.lit(float(k + 1)) / F.col("n"), F.lit(1.0 / len(dims)))).alias("h0"), F.least(F.lit(k), F.col("n") - (1 if skip_self else 0)).alias("want")))
    pending = cut(queries.select(G, "qid", *dims))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"{G} {kind(queries, G)}, qid {kind(queries, 'qid')}, rank int, node_id {kind(nodes, 'node_id')}, dist double"
    tile = [f"t{c}" for c in dims]
    found = []
    for step in range(64):
        g = grid.withColumn("h", F.least(F.col("h0") * float(2**step), F.col("span")))
        at = lambda c, o=0: F.floor((F.floor(F.col(c) / F.col("h")) + o) / TILE)
        q = pending.join(g, G).select(G, "qid", "h", "span", "want", *[F.col(c).cast("double").alias(f"q{c}") for c in dims], *[at(c).alias(f"t{c}") for c in dims])
        load = q.groupBy(G, *tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_QUERIES)).cast("int").alias("salts"))
        q = q.join(load, [G, *tile]).withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int")).drop("salts")
        p = nodes.join(g.select(G, "h"), G)
        for c in dims:  # one after the other: few nodes lie at the sides of a tile
            p = p.withColumn(f"t{c}", F.explode(F.array_distinct(F.array(at(c, -1), at(c, 0), at(c, 1)))))
        p = p.select(G, "node_id", *[F.col(c).cast("double").alias(f"p{c}") for c in dims], *tile).join(load, [G, *tile])
        p = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        key = [G, *tile, "salt"]
        q, p = q.toDF(*q.columns), p.toDF(*p.columns)  # own names for both sides: a cogroup of one lineage is ambiguous
        found.append(cut(q.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(_nearest(dims, k, skip_self), schema)))
        pending = cut(pending.join(found[-1].select(G, "qid").distinct(), [G, "qid"], "left_anti"))
        if pending.limit(1).count() == 0:
            return reduce(DataFrame.union, found)
        if step > 0 and grid.where(F.col("h0") * float(2**step) < F.col("span")).limit(1).count() == 0:
            break
    return reduce(DataFrame.union, found)  # whatever is left has no node in its graph


def knn_edges(nodes: DataFrame, k: int, dims=("x", "y")) -> DataFrame:
    nn = knn(nodes.select(G, F.col("node_id").alias("qid"), *dims), nodes, k, dims, skip_self=True)
    return nn.select(G, F.least("qid", "node_id").alias("src"), F.greatest("qid", "node_id").alias("dst")).distinct()


def torus_tiles(nodes: DataFrame, dims=("u", "v")) -> DataFrame:
    """Nine unit translations of a chart, so a planar search wraps around the torus."""
    off = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in product((-1, 0, 1), repeat=2)]))
    t = nodes.select(G, "node_id", *dims, off.alias("o"))
    return t.select(G, "node_id", (F.col(dims[0]) + F.col("o.a")).alias(dims[0]), (F.col(dims[1]) + F.col("o.b")).alias(dims[1]))
