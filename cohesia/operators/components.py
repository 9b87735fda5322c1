"""Connected components of every graph at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, tasks

G = "graph_id"
LOCAL_EDGES = 20_000


def components(edges: DataFrame, nodes: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph_id, node_id, comp): comp is the smallest node id reachable; edge weights are ignored.

    Graphs of at most `local_edges` edges settle inside their own group after one shuffle; larger
    ones settle together as joins. Nodes without edges are their own component.
    """
    links = cut(edges.where("src <> dst").select(G, "src", "dst"))
    size = cut(links.groupBy(G).agg((F.count(F.lit(1)) <= local_edges).alias("fits"), F.count(F.lit(1)).alias("rows")))
    fits, large, rows = size.agg(F.count_if("fits"), F.count_if(~F.col("fits")), F.sum("rows")).first()
    parts = []
    if fits:
        ok = links.join(size.where("fits"), G, "left_semi") if large else links
        parts.append(ok.groupBy(G).applyInPandas(_label_group, "graph_id string, node_id long, comp long"))
    if large:
        # A graph's name alone would bring a large graph to one task.
        wide = tasks(edges.sparkSession, 2 * rows)
        of = size.where("not fits").select(G, F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("salt"))
        own = lambda df, key: df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(wide)).cast("int")).join(of, [G, "salt"], "left_semi").drop("salt")
        parts.append(_label_all(own(links, "dst") if fits else links, local_edges))
    base = nodes.select(G, "node_id").distinct()
    if not parts:
        return base.withColumn("comp", F.col("node_id"))
    out = base.join(reduce(DataFrame.union, parts), [G, "node_id"], "left")
    return cut(out.select(G, "node_id", F.coalesce("comp", "node_id").alias("comp")))


def _label_group(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
    ids = np.unique(np.concatenate([src, dst]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    lab = np.arange(len(ids))
    while True:
        new = lab.copy()
        np.minimum.at(new, a, lab[b])
        np.minimum.at(new, b, lab[a])
        new = new[new]
        if (new == lab).all():
            return pd.DataFrame({G: pdf[G].iloc[0], "node_id": ids, "comp": ids[lab]})
        lab = new


def _label_all(edges: DataFrame, local_edges: int, max_rounds: int = 60) -> DataFrame:
    """Labels of all nodes but the smallest of each component: links shrink round by round until none is left.

    A node whose only link leads to a smaller one has that node's label: it leaves the links and is looked up at the end.
    Where that takes less than half of the links, the rest is drawn together by a large-star and a small-star round: every
    node hands its smallest neighbour to its larger neighbours, then to its smaller ones and itself.
    Minima are combined before the shuffle; a hub is only ever a hot key of a join whose other side has one
    row for it, which AQE splits. O(log n) rounds in practice. The last `local_edges` links settle in their groups.
    """
    links = cut(edges.where("src <> dst").select(G, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    left, settled = links.count(), []
    for _ in range(max_rounds):
        if left <= local_edges:
            rest = links.toDF(G, "src", "dst").groupBy(G).applyInPandas(_label_group, "graph_id string, node_id long, comp long")
            return _looked_up([*settled, cut(rest)])
        ends = links.union(links.select(G, "b", "a")).toDF(G, "u", "v").groupBy(G, "u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        leaves = cut(ends.where("n = 1 and v < u").select(G, F.col("u").alias("node_id"), F.col("v").alias("comp")))
        taken = leaves.count()  # as many links: of two nodes with one link, only the larger leaves
        if taken:
            settled.append(leaves)
            links = cut(links.join(leaves.select(G, F.col("node_id").alias("a")), [G, "a"], "left_anti"))
        if taken == left:
            return _looked_up(settled)
        if 2 * taken < left:
            links = cut(_stars(links))
        left = links.count()
    raise RuntimeError("components did not settle; raise max_rounds")


def _stars(links: DataFrame) -> DataFrame:
    """A large-star and a small-star round over links (a, b), a > b."""
    both = links.union(links.select(G, "b", "a")).toDF(G, "u", "v")
    low = both.groupBy(G, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, [G, "u"]).where("v > u").select(G, F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy(G, "a").agg(F.min("b").alias("m"))
    pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
    return large.join(low, [G, "a"]).select(G, F.explode(pair).alias("e")).select(G, "e.*").where("a <> b").distinct()


def _looked_up(settled: list[DataFrame]) -> DataFrame:
    """Labels of the nodes of all rounds: a node's link leads to a node of a later round, or to its component's smallest."""
    found = settled[-1]
    for leaves in settled[-2::-1]:
        top = found.select(G, F.col("node_id").alias("comp"), F.col("comp").alias("top"))
        found = cut(leaves.join(top, [G, "comp"], "left").select(G, "node_id", F.coalesce("top", "comp").alias("comp")).union(found))
    return found


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id) of each graph's largest component; ties go to the lowest label."""
    comp = components(edges, nodes)
    size = comp.groupBy(G, "comp").agg(F.count(F.lit(1)).alias("c"))
    best = size.groupBy(G).agg(F.max_by("comp", F.struct(F.col("c"), -F.col("comp"))).alias("comp"))
    return comp.join(best, [G, "comp"]).select(G, "node_id")


def restrict_to_largest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component, re-indexed densely in id order."""
    from .mesh import reindex

    out_nodes, _, out_edges = reindex(nodes, largest_component(nodes, edges), edges=edges)
    return out_nodes, out_edges


def threshold_subgraph(edges: DataFrame, nodes: DataFrame, t: float, col: str = "fibrosis") -> tuple[DataFrame, DataFrame]:
    """Drop edges touching a node above t, unit weights, largest component.

    Nodes left isolated can only be the largest component when every edge is gone.
    """
    from ..plans.joins import endpoints

    e = endpoints(edges.select(G, "src", "dst"), nodes, [col]).where(
        (F.col(f"{col}_s") <= t) & (F.col(f"{col}_d") <= t)
    )
    return restrict_to_largest(nodes, e.select(G, "src", "dst", F.lit(1.0).alias("w")))
