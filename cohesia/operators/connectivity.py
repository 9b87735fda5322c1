"""Connectivity descriptors: patches, percolation, minimum cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import exponential, uniform
from ..plans.joins import endpoints
from ..plans.lineage import cut
from ..plans.ordered import row_numbers, running_sums
from .components import components
from .spectrum import adjacency, degree, fiedler

G = "graph_id"
EXACT_CUT_NODES = 16


def random_walk(edges: DataFrame) -> DataFrame:
    """Row-normalised adjacency (graph_id, src, dst, p)."""
    adj = adjacency(edges)
    deg = adj.groupBy(G, "src").agg(F.sum("w").alias("d"))
    return adj.join(deg, [G, "src"]).select(G, "src", "dst", F.when(F.col("d") > 0, F.col("w") / F.col("d")).otherwise(F.lit(0.0)).alias("p"))


def patch_size(nodes: DataFrame, edges: DataFrame, t: float = 0.5, col: str = "fibrosis") -> DataFrame:
    """Mean size of components of nodes at or above t; 0 when there are none."""
    hot = nodes.where(F.col(col) >= t).select(G, "node_id")
    keep = endpoints(edges.select(G, "src", "dst"), nodes.select(G, "node_id", col), [col]).where((F.col(f"{col}_s") >= t) & (F.col(f"{col}_d") >= t))
    size = components(keep, hot).groupBy(G, "comp").agg(F.count(F.lit(1)).alias("c"))
    mean = size.groupBy(G).agg(F.avg("c").alias("patch_size"))
    return nodes.select(G).distinct().join(mean, G, "left").na.fill({"patch_size": 0.0})


def removal_order(edges: DataFrame, seed: int) -> DataFrame:
    """Edges with their 0-based position in one random order per graph."""
    drawn = edges.select(G, "src", "dst").withColumn("__u", uniform(seed, G, "src", "dst"))
    return row_numbers(drawn, [G], [F.col("__u"), F.col("src"), F.col("dst")], "pos").drop("__u")


def percolation(edges: DataFrame, nodes: DataFrame, steps: int = 25, seed: int = 0) -> DataFrame:
    """Smallest removed share (of `steps` levels, one edge order) at which the giant component is under half.

    Every level of every graph is one graph of a single components run.
    """
    size = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    order = cut(removal_order(edges.where("src <> dst"), seed))
    m = edges.where("src <> dst").groupBy(G).agg(F.count(F.lit(1)).alias("m"))
    ok = cut(size.join(m, G).where("n >= 2 and m > 0"))
    lv = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("lv")
    drop_n = F.bround(F.col("lv") / F.lit(float(steps)) * F.col("m"), 0)
    key = F.concat_ws("#", G, F.col("lv").cast("string"))
    levels = ok.select(G, "n", "m", lv)
    e = order.join(levels, G).where(F.col("pos") >= drop_n).select(key.alias(G), "src", "dst")
    v = nodes.select(G, "node_id").join(levels, G).select(key.alias(G), "node_id")
    giant = components(e, v).groupBy(G, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col(G).alias("__k")).agg(F.max("c").alias("giant"))
    j = levels.withColumn("__k", key).join(giant, "__k")
    first = j.where(F.col("giant") < 0.5 * F.col("n")).groupBy(G).agg((F.min("lv") / F.lit(float(steps))).alias("f"))
    out = size.join(ok.select(G, F.lit(True).alias("ok")), G, "left").join(first, G, "left")
    return out.select(G, F.when(F.col("ok"), F.coalesce("f", F.lit(1.0))).otherwise(F.lit(0.0)).alias("percolation"))


def spanning_forest(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Maximum spanning forest by `key` (Boruvka): each component picks its best outgoing edge per round."""
    comp = cut(nodes.select(G, "node_id", F.col("node_id").alias("c")))
    chosen = None
    for _ in range(64):
        a = comp.select(G, F.col("node_id").alias("src"), F.col("c").alias("cs"))
        b = comp.select(G, F.col("node_id").alias("dst"), F.col("c").alias("cd"))
        out = edges.join(a, [G, "src"]).join(b, [G, "dst"]).where("cs <> cd")
        pick = F.struct(F.col(key).alias("k"), "src", "dst", "cs", "cd")
        best = out.select(G, pick.alias("e"), F.explode(F.array("cs", "cd")).alias("c")).groupBy(G, "c").agg(F.max("e").alias("e"))
        new = cut(best.select(G, "e.src", "e.dst", F.col("e.k").alias(key), "e.cs", "e.cd").distinct())
        picked = new.select(G, "src", "dst", key)
        if new.limit(1).count() == 0:
            return chosen if chosen is not None else picked
        chosen = picked if chosen is None else chosen.union(picked)
        # Only the labels that were linked in this round are merged.
        links = new.select(G, F.col("cs").alias("src"), F.col("cd").alias("dst"))
        merged = components(links, comp.select(G, F.col("c").alias("node_id"))).select(G, F.col("node_id").alias("c"), "comp")
        comp = cut(comp.join(merged, [G, "c"]).select(G, "node_id", F.col("comp").alias("c")))
    raise RuntimeError("spanning forest did not settle")


def exact_min_cut(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Global minimum cut of graphs with at most 16 nodes by enumerating bipartitions; 0 when disconnected."""
    size = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, EXACT_CUT_NODES))
    ids = row_numbers(nodes.join(size, G, "left_semi").select(G, "node_id"), [G], [F.col("node_id")], "b", group_rows=EXACT_CUT_NODES)
    e = endpoints(edges.where("src <> dst").join(size, G, "left_semi"), ids, ["b"]).groupBy(G).agg(
        F.collect_list(F.struct(F.col("b_s").cast("int").alias("p"), F.col("b_d").cast("int").alias("q"), "w")).alias("e")
    )
    j = size.join(e, G, "left").withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.col("n") - 1).cast("int") - 1)))
    value = F.expr("aggregate(e, 0.0D, (s, r) -> s + if(((mask >> r.p) & 1) <> ((mask >> r.q) & 1), r.w, 0.0D))")
    return j.withColumn("cut", F.coalesce(value, F.lit(0.0))).groupBy(G).agg(F.min("cut").alias("min_cut"))


def min_cut_bound(edges: DataFrame, nodes: DataFrame, trials: int = 4, seed: int = 0) -> DataFrame:
    """Upper and lower bounds on the global minimum cut, with a certificate when they meet.

    Exact for at most 16 nodes. Otherwise the upper bound is the best of the smallest weighted
    degree, every Fiedler sweep cut and `trials` random contractions; lambda2 (n-1)/n bounds below.
    0 for fewer than two nodes, no edges or a disconnected topology. `trials` is the number of
    contractions behind the bound; each one meets the minimum cut with probability at least 2 / (n (n - 1)).
    """
    e = cut(adjacency(edges.where("src <> dst")).where("src < dst"))
    size = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    comp = components(e, nodes)
    linked = cut(comp.groupBy(G).agg((F.min("comp") == F.max("comp")).alias("one")).join(size, G))
    live = linked.where("one and n >= 2")
    small, large = live.where(F.col("n") <= EXACT_CUT_NODES), live.where(F.col("n") > EXACT_CUT_NODES)
    exact = exact_min_cut(e.join(small, G, "left_semi"), nodes.join(small, G, "left_semi"))
    done = exact.select(G, F.col("min_cut").alias("value"), F.col("min_cut").alias("lower"))
    if large.limit(1).count():
        le, ln = cut(e.join(large, G, "left_semi")), cut(nodes.select(G, "node_id").join(large, G, "left_semi"))
        phi = fiedler(le, ln)
        low = phi.groupBy(G).agg((F.max("lambda2") * (F.count(F.lit(1)) - 1) / F.count(F.lit(1))).alias("lower"))
        best = degree(le).groupBy(G).agg(F.min("deg").alias("v"))
        best = best.union(sweep_cut(le, phi)).union(contraction_cut(le, ln, trials, seed))
        up = best.groupBy(G).agg(F.min("v").alias("value"))
        done = done.union(up.join(low, G).select(G, "value", "lower"))
    tried = F.when(F.col("one") & (F.col("n") > EXACT_CUT_NODES), F.lit(trials)).otherwise(F.lit(0)).alias("trials")
    out = linked.select(G, tried).join(done, G, "left").na.fill(0.0)
    return out.withColumn("certified", F.col("value") - F.col("lower") <= 1e-9 * F.greatest(F.col("value"), F.lit(1.0)))


def sweep_cut(edges: DataFrame, phi: DataFrame) -> DataFrame:
    """Best prefix cut of each graph's nodes ordered by phi, by prefix sums of edge openings and closings."""
    pos = cut(row_numbers(phi.select(G, "node_id", "phi"), [G], [F.col("phi"), F.col("node_id")], "pos"))
    e = endpoints(edges, pos, ["pos"])
    lo, hi = F.least("pos_s", "pos_d"), F.greatest("pos_s", "pos_d")
    ev = e.select(G, F.explode(F.array(F.struct(lo.alias("pos"), F.col("w").alias("d")), F.struct(hi.alias("pos"), (-F.col("w")).alias("d")))).alias("v"))
    ev = ev.groupBy(G, "v.pos").agg(F.sum("v.d").alias("d"))
    run = running_sums(ev, [G], [F.col("pos")], {"before": F.col("d")})
    last = pos.groupBy(G).agg(F.max("pos").alias("last"))
    return run.join(last, G).where("pos < last").groupBy(G).agg(F.min(F.col("before") + F.col("d")).alias("v"))


def contraction_cut(edges: DataFrame, nodes: DataFrame, trials: int, seed: int) -> DataFrame:
    """Random contraction: keep the earliest-ringing forest, drop its last edge, weigh the bipartition."""
    t = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    key = F.concat_ws("#", G, F.col("trial").cast("string"))
    e = edges.select(G, "src", "dst", "w", t).where("w > 0")
    clock = exponential(seed, G, "trial", "src", "dst") / F.col("w")
    e = cut(e.select(key.alias(G), "src", "dst", "w", (-clock).alias("k")))
    n = nodes.select(G, "node_id", t).select(key.alias(G), "node_id")
    forest = cut(spanning_forest(e, n, "k"))
    worst = forest.groupBy(G).agg(F.min(F.struct("k", "src", "dst")).alias("x"))
    kept = forest.join(worst.select(G, "x.src", "x.dst"), [G, "src", "dst"], "left_anti")
    side = components(kept, n)
    cutw = endpoints(e, side, ["comp"]).where("comp_s <> comp_d").groupBy(G).agg(F.sum("w").alias("v"))
    return cutw.groupBy(F.split(G, "#")[0].alias(G)).agg(F.min("v").alias("v"))
