"""Shortest paths and quantities built on them, all graphs relaxed together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import clip
from ..plans.lineage import cut
from .mesh import edge_length

G = "graph_id"
LOCAL_EDGES = 20_000


def shortest_paths(costs: DataFrame, nodes: DataFrame, sources: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Distance from the nearest source over costs(graph_id,src,dst,cost); NULL when unreachable.

    Graphs of at most `local_edges` edges relax inside their own group after one shuffle; larger
    ones relax together, hop by hop, as joins.
    """
    from functools import reduce

    costs = cut(costs.where("src <> dst").select(G, "src", "dst", "cost"))
    sources = cut(sources.select(G, "node_id").distinct())
    size = cut(costs.groupBy(G).agg((F.count(F.lit(1)) <= local_edges).alias("fits")))
    fits, large = size.agg(F.count_if("fits"), F.count_if(~F.col("fits"))).first()
    parts = [sources.select(G, "node_id", F.lit(0.0).alias("d"))]
    if fits:
        ok = size.where("fits").select(G)
        seeds = sources.select(G, F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("cost"))
        parts.append(costs.union(seeds).join(ok, G, "left_semi").groupBy(G).applyInPandas(_relax_group, "graph_id string, node_id long, d double"))
    if large:
        big = size.where("not fits").select(G)
        parts.append(_relax_all(costs.join(big, G, "left_semi"), sources.join(big, G, "left_semi")))
    best = reduce(DataFrame.union, parts).groupBy(G, "node_id").agg(F.min("d").alias("dist"))
    return nodes.select(G, "node_id").join(best, [G, "node_id"], "left")


def _relax_group(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst, cost = pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["cost"].to_numpy()
    ids = np.unique(np.concatenate([src, dst]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    d = np.full(len(ids), np.inf)
    d[a[a == b]] = 0.0
    while True:
        new = d.copy()
        np.minimum.at(new, b, d[a] + cost)
        np.minimum.at(new, a, d[b] + cost)
        if (new == d).all():
            break
        d = new
    ok = np.isfinite(d)
    return pd.DataFrame({G: pdf[G].iloc[0], "node_id": ids[ok], "d": d[ok]})


def _relax_all(costs: DataFrame, sources: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Only nodes improved in the previous hop send; arrivals are min-combined before the shuffle."""
    links = cut(costs.union(costs.select(G, F.col("dst"), F.col("src"), "cost")))  # not dealt by node: AQE splits a hub's join
    start = sources.select(G, "node_id", F.lit(0.0).alias("d")).distinct()
    state = cut(start.withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        send = state.where("moved").select(G, F.col("node_id").alias("src"), "d")
        got = links.join(send, [G, "src"]).select(G, F.col("dst").alias("node_id"), (F.col("d") + F.col("cost")).alias("d"), F.lit(None).cast("double").alias("old"))
        both = got.union(state.select(G, "node_id", "d", F.col("d").alias("old")))
        best = both.groupBy(G, "node_id").agg(F.min("d").alias("d"), F.max("old").alias("old"))
        state = best.select(G, "node_id", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("moved"))
        state = cut(state)
        if state.where("moved").limit(1).count() == 0:
            return state.select(G, "node_id", "d")
    raise RuntimeError("shortest paths did not settle")


def geodesic_from(edges: DataFrame, nodes: DataFrame, sources: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Geometric distance along edges from one source per graph."""
    return shortest_paths(edge_length(edges.select(G, "src", "dst"), nodes).withColumnRenamed("length", "cost"), nodes, sources, local_edges)


def activation_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Travel time length / sqrt(w / wmax), relative weight clipped to [1e-12, 1], length floored."""
    top = edges.groupBy(G).agg(F.max("w").alias("wmax"))
    e = edge_length(edges, nodes).join(top, G)
    rel = F.when(F.col("wmax") > 0, clip(F.col("w") / F.col("wmax"), 1e-12, 1.0)).otherwise(F.lit(1e-12))
    return e.select(G, "src", "dst", (F.greatest(F.col("length"), F.lit(1e-12)) / F.sqrt(rel)).alias("cost"))


def activation(edges: DataFrame, nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """Earliest arrival from any site(graph_id,node_id)."""
    return shortest_paths(activation_costs(edges, nodes), nodes, sites)


def eccentricity(dist: DataFrame) -> DataFrame:
    return dist.groupBy(G).agg(F.max("dist").alias("diameter"))
