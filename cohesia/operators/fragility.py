"""Spectral descriptors and fragility of algebraic connectivity, per graph, edge and region."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import erlang
from ..plans.joins import clip, endpoints
from . import paths
from .spectrum import degree, eigenvalues, fiedler, perron, smallest_eigpairs
from .updates import low_values

G = "graph_id"
REGIONS = "region"


# ---- scalar descriptors ----------------------------------------------------------------------


def ipr(df: DataFrame, col: str, name: str = "ipr") -> DataFrame:
    """Inverse participation ratio per graph; 0 for a zero vector."""
    x = F.col(col)
    s = df.groupBy(G).agg(F.sum(x * x * x * x).alias("s4"), F.sum(x * x).alias("s2"))
    return s.select(G, F.when(F.col("s2") > 0, F.col("s4") / (F.col("s2") * F.col("s2"))).otherwise(F.lit(0.0)).alias(name))


def cheeger(l2: Column) -> Column:
    """Midpoint of the Cheeger bounds l2/2 and sqrt(2 l2)."""
    x = F.greatest(l2, F.lit(0.0))
    return (x / 2 + F.sqrt(2 * x)) / 2


def low_spectrum(pairs: DataFrame, t: float = 1.0, zero: float = 1e-9) -> DataFrame:
    """Entropy of the normalised low eigenvalues, near-zero count and partial heat trace per graph."""
    v = eigenvalues(pairs)
    lv = F.greatest(F.col("val"), F.lit(0.0))
    tot = v.groupBy(G).agg(F.sum(lv).alias("tot"))
    p = lv / F.col("tot")
    ent = F.sum(F.when((F.col("tot") > 0) & (lv > 0), -p * F.log(p)).otherwise(F.lit(0.0)))
    return v.join(tot, G).groupBy(G).agg(
        ent.alias("spectral_entropy"), F.count_if(F.col("val") < zero).alias("n_near_zero"), F.sum(F.exp(-lv * t)).alias("heat_trace")
    )


def spectral_features(edges: DataFrame, nodes: DataFrame, k: int = 6, pairs: DataFrame | None = None) -> DataFrame:
    """Wide per-graph spectral block from one shared eigen table."""
    pairs = smallest_eigpairs(edges, nodes, k) if pairs is None else pairs
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("val")))
    lam = eigenvalues(pairs).groupBy(G).agg(at(1).alias("l2"), at(2).alias("l3"))
    phi = pairs.where("idx = 1")
    ph = phi.groupBy(G).agg(F.avg(F.abs("x")).alias("fiedler_abs_mean"), F.max(F.abs("x")).alias("fiedler_abs_max"))
    out = low_spectrum(pairs).join(lam, G).join(ipr(perron(edges, nodes), "perron", "perron_ipr"), G)
    out = out.join(ipr(phi, "x", "fiedler_ipr"), G, "left").join(ph, G, "left")
    return out.select(
        G, F.coalesce(F.col("l3") - F.col("l2"), F.lit(0.0)).alias("gap"), "spectral_entropy", cheeger(F.coalesce("l2", F.lit(0.0))).alias("cheeger"),
        "n_near_zero", "perron_ipr", "heat_trace", F.coalesce("l2", F.lit(0.0)).alias("lambda2"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fiedler_ipr", "fiedler_abs_mean", "fiedler_abs_max")],
    )


def burden(nodes: DataFrame, col: str = "fibrosis") -> DataFrame:
    return nodes.groupBy(G).agg(F.coalesce(F.avg(col), F.lit(0.0)).alias("burden"))


def field_entropy(nodes: DataFrame, col: str = "fibrosis", bins: int = 16) -> DataFrame:
    b = F.least(F.floor(clip(F.col(col), 0.0, 1.0) * bins), F.lit(bins - 1))
    c = nodes.groupBy(G, b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy(G).agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return c.join(t, G).groupBy(G).agg((-F.sum(p * F.log(p)) / F.lit(math.log(bins)) + F.lit(0.0)).alias("entropy"))


# ---- fragility -------------------------------------------------------------------------------


def edge_fragility(edges: DataFrame, phi: DataFrame, col: str = "phi") -> DataFrame:
    e = endpoints(edges, phi, [col])
    d = F.col(f"{col}_s") - F.col(f"{col}_d")
    return e.select(*edges.columns, (d * d).alias("frag"))


def perturbation_field(edges: DataFrame, nodes: DataFrame, mu=0.15, cov=0.5, coupling=1.0) -> DataFrame:
    """Mean and variance of each edge's weight reduction, growing with endpoint fibrosis."""
    e = endpoints(edges, nodes, ["fibrosis", REGIONS])
    frac = F.lit(mu) * (1 + F.lit(coupling) * (F.col("fibrosis_s") + F.col("fibrosis_d")) / 2)
    mean = F.greatest(frac, F.lit(0.0)) * F.col("w")
    return e.select(*edges.columns, edge_region().alias("region"), mean.alias("dw"), (F.lit(cov * cov) * mean * mean).alias("var"))


def edge_region() -> Column:
    return F.when(F.col("region_s") == F.col("region_d"), F.col("region_s")).otherwise(F.lit(-1)).cast("long")


def sfi_edges(edges: DataFrame, nodes: DataFrame, phi: DataFrame, **field) -> DataFrame:
    """Edges with region, dw, var, frag and their product sfi."""
    out = edge_fragility(perturbation_field(edges, nodes, **field), phi)
    return out.withColumn("sfi", F.col("dw") * F.col("frag"))


def sfi_region(scored: DataFrame) -> DataFrame:
    return scored.groupBy(G, "region").agg(F.sum("sfi").alias("sfi"))


def region_summary(regions: DataFrame, col: str, top: int = 3) -> DataFrame:
    """total, region max/mean/population sd, then top1..topK of a per-region table."""
    s = regions.groupBy(G).agg(F.sum(col).alias("total"), F.max(col).alias("region_max"), F.avg(col).alias("region_mean"), F.stddev_pop(col).alias("region_std"))
    rank = F.row_number().over(Window.partitionBy(G).orderBy(F.col(col).desc()))
    best = regions.select(G, col, rank.alias("__r")).where(F.col("__r") <= top)  # the limit is applied before the shuffle
    best = best.groupBy(G).agg(*[F.coalesce(F.max(F.when(F.col("__r") == i, F.col(col))), F.lit(0.0)).alias(f"top{i}") for i in range(1, top + 1)])
    return s.join(best, G)


def sfi_features(edges: DataFrame, nodes: DataFrame, phi: DataFrame | None = None, **field) -> DataFrame:
    """Nine-column summary; zeros for graphs with fewer than two nodes or no edges."""
    phi = fiedler(edges, nodes) if phi is None else phi
    scored = sfi_edges(edges, nodes, phi, **field)
    frag = scored.groupBy(G).agg(F.max("frag").alias("edge_frag_max"), F.avg("frag").alias("edge_frag_mean"))
    out = region_summary(sfi_region(scored), "sfi").join(frag, G)
    return nodes.select(G).distinct().join(out, G, "left").na.fill(0.0)


def validity_ok(norm: Column, gap: Column, safety: float = 0.5) -> Column:
    return norm <= F.lit(safety) * gap


def subspace_fragility(edges: DataFrame, pairs: DataFrame, k_dim: int = 2) -> DataFrame:
    """Rotation-invariant fragility over modes 2..k_dim+1, one row per edge."""
    vec = pairs.where(F.col("idx").between(1, max(k_dim, 1))).groupBy(G, "node_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("q")
    )
    e = endpoints(edges, vec, ["q"])
    sq = F.aggregate(F.zip_with("q_s", "q_d", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return e.select(*edges.columns, sq.alias("frag"))


# ---- perturb and recompute: only the changed edges of a perturbed graph are carried ---------------


def exact_delta(edges: DataFrame, nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Signed change of lambda2 for each edit(graph_id, variant, src, dst, dw) of one edge."""
    base = fiedler(edges, nodes).groupBy(G).agg(F.max("lambda2").alias("base"))
    new = low_values(edges, nodes, edits.withColumn("drop", -F.col("dw")), 2)
    return new.join(base, G).select(G, "variant", (F.col("l2") - F.col("base")).alias("delta"))


def exact_region_delta(edges: DataFrame, nodes: DataFrame, **field) -> DataFrame:
    """Exact drop of lambda2 when each region (and '_all') takes its mean reduction."""
    f = perturbation_field(edges, nodes, **field)
    tagged = f.select(G, F.explode(F.array(F.col("region").cast("string"), F.lit("_all"))).alias("variant"), "src", "dst", F.col("dw").alias("drop"))
    base = fiedler(edges, nodes).groupBy(G).agg(F.max("lambda2").alias("base"))
    return low_values(edges, nodes, tagged, 2).join(base, G).select(G, F.col("variant").alias("region"), (F.col("base") - F.col("l2")).alias("drop"))


def sample_dw(field: DataFrame, draws: int, seed: int, cov: float = 0.5) -> DataFrame:
    """Gamma(mean dw, variance var) reduction per edge and draw, below 0.999 w; the mean where var = 0.

    The shape 1/cov^2 is one constant per run: an integer shape is a sum of exponentials, any
    other shape goes through a vectorised rejection sampler seeded by the row key.
    """
    f = field.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keys = [G, "src", "dst", "region_key", "draw"] if "region_key" in field.columns else [G, "src", "dst", "draw"]
    if cov <= 0:
        drawn = F.col("dw")
    else:
        shape = 1.0 / (cov * cov)
        if abs(shape - round(shape)) < 1e-9:
            unit = erlang(int(round(shape)), seed, *keys) / F.lit(float(round(shape)))
        else:
            unit = _gamma(shape)(F.xxhash64(F.lit(seed), *keys)) / F.lit(shape)
        drawn = F.when((F.col("dw") > 0) & (F.col("var") > 0), unit * F.col("dw")).otherwise(F.col("dw"))
    return f.withColumn("drop", F.least(drawn, F.lit(0.999) * F.col("w")))


def _gamma(shape: float):
    @F.pandas_udf("double")
    def draw(key: pd.Series) -> pd.Series:
        """Marsaglia-Tsang with counter-based normals, so a row's draw depends on its key only."""
        bits = key.to_numpy().astype(np.uint64)
        a = shape if shape >= 1 else shape + 1.0
        d = a - 1.0 / 3.0
        c = 1.0 / math.sqrt(9.0 * d)

        def u(step):
            z = bits + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53

        out = np.full(len(bits), np.nan)
        step = 0
        while np.isnan(out).any():
            n = np.sqrt(-2 * np.log1p(-u(step))) * np.cos(2 * math.pi * u(step + 1))
            v = (1 + c * n) ** 3
            ok = (v > 0) & (np.log(np.maximum(u(step + 2), 1e-300)) < 0.5 * n * n + d - d * v + d * np.log(np.where(v > 0, v, 1.0)))
            take = ok & np.isnan(out)
            out[take] = d * v[take]
            step += 3
        if shape < 1:
            out *= u(10_001) ** (1.0 / shape)
        return pd.Series(out)

    return draw


def sfi_monte_carlo(edges: DataFrame, nodes: DataFrame, draws: int, seed: int, **field) -> DataFrame:
    """Per region and '_all': mean, sd (n-1), standard error of the exact drop over sampled reductions."""
    f = perturbation_field(edges, nodes, **field)
    f = f.withColumn("region_key", F.explode(F.array(F.col("region").cast("string"), F.lit("_all"))))
    s = sample_dw(f, draws, seed, field.get("cov", 0.5))
    tagged = s.select(G, F.concat_ws("@", "region_key", F.col("draw").cast("string")).alias("variant"), "src", "dst", "drop")
    base = fiedler(edges, nodes).groupBy(G).agg(F.max("lambda2").alias("base"))
    lam = low_values(edges, nodes, tagged, 2).join(base, G).withColumn("region", F.split("variant", "@")[0])
    d = F.col("base") - F.col("l2")
    out = lam.groupBy(G, "region").agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.count(F.lit(1)).alias("cnt"))
    std = F.coalesce("std", F.lit(0.0))
    return out.select(G, "region", "mean", std.alias("std"), (std / F.sqrt("cnt")).alias("se"), "cnt")


def _sweep(edges: DataFrame, nodes: DataFrame, grid, mask: Column) -> DataFrame:
    """Shared body of the sweeps: per (graph, t) first-order and subspace predictions against exact drops."""
    from ..plans.lineage import cut

    pairs = smallest_eigpairs(edges, nodes, 3)
    vals = eigenvalues(pairs)
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("val")))
    base = cut(vals.groupBy(G).agg(at(1).alias("b2"), at(2).alias("b3")))
    phi = pairs.where("idx = 1").select(G, "node_id", F.col("x").alias("phi"))
    e = edge_fragility(edges, phi).withColumnRenamed("frag", "f1")
    e = subspace_fragility(e, pairs, 2).withColumnRenamed("frag", "f2").withColumn("hit", mask)
    v = cut(grid_rows(e.where("hit"), grid, "step", "t").withColumn("drop", F.col("t") * F.col("w")).withColumn("variant", F.col("step").cast("string")))
    pred = v.groupBy(G, "variant", "t").agg(F.sum(F.col("drop") * F.col("f1")).alias("pred_first"), F.sum(F.col("drop") * F.col("f2")).alias("pred_sub"))
    lam = low_values(edges, nodes, v, 3)
    key = F.concat_ws("#", G, F.col("variant").cast("string"))
    from .spectrum import lap_norm

    changed = v.select(key.alias(G), "src", "dst", F.col("drop").alias("dw"))
    ends = changed.select(G, F.explode(F.array("src", "dst")).alias("node_id")).distinct()  # other nodes add nothing to the norm
    norm = lap_norm(changed, ends)
    j = pred.join(lam, [G, "variant"]).join(base, G).withColumn("__k", key).join(norm.withColumnRenamed(G, "__k"), "__k")
    from ..functions.fields import relative_error

    exact, both = F.col("b2") - F.col("l2"), F.col("b2") + F.col("b3") - F.col("l2") - F.col("l3")
    return j.select(
        G, "t", (F.col("norm") / F.greatest(F.col("b3") - F.col("b2"), F.lit(1e-12))).alias("rho"), exact.alias("exact"), both.alias("exact_sum"),
        "pred_first", "pred_sub", relative_error(F.col("pred_first"), exact).alias("err_first"), relative_error(F.col("pred_sub"), both).alias("err_sub"),
        (F.abs(exact) <= F.col("norm") + F.lit(1e-9)).alias("weyl_ok"), (F.col("b3") - F.col("b2")).alias("gap"),
    )


def grid_rows(df: DataFrame, grid, step: str, value: str) -> DataFrame:
    """Each row once per value of a parameter grid."""
    items = [F.struct(F.lit(i).cast("long").alias(step), F.lit(float(t)).alias(value)) for i, t in enumerate(grid)]
    return df.select("*", F.explode(F.array(*items)).alias("__g")).select(*df.columns, "__g.*")


def validity_sweep(edges: DataFrame, nodes: DataFrame, grid=(0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.55, 0.75, 0.95), block: int = 3) -> DataFrame:
    """Reduce each graph's first `block` edges by t and score the predictions."""
    from ..plans.ordered import row_numbers

    first = row_numbers(edges.select(G, "src", "dst", "w"), [G], [F.col("src"), F.col("dst")], "pos")
    return _sweep(first, nodes, grid, F.col("pos") < block)


def rho_star(sweep: DataFrame, limit: float = 0.10) -> DataFrame:
    over = sweep.where(F.col("err_first") > limit).groupBy(G).agg(F.min_by("rho", "t").alias("rho_star"))
    return sweep.select(G).distinct().join(over, G, "left")


def degeneracy_sweep(edges: DataFrame, nodes: DataFrame, bridge: str, levels, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Scale the bridge edges by each level (shrinking the gap) under one fixed masked reduction."""
    from ..functions.rng import uniform

    e = edges.select(G, "src", "dst", "w", F.col(bridge).alias("b")).withColumn("hit", uniform(seed, G, "src", "dst") < share)
    e = grid_rows(e, levels, "lv", "level").select(F.concat_ws("~", G, "lv").alias(G), "src", "dst", F.when(F.col("b"), F.col("w") * F.col("level")).otherwise(F.col("w")).alias("w"), "hit")
    n = grid_rows(nodes.select(G, "node_id"), levels, "lv", "level").select(F.concat_ws("~", G, "lv").alias(G), "node_id")
    out = _sweep(e, n, [share], F.col("hit"))
    tag = F.split(G, "~")
    return out.select(tag[0].alias(G), tag[1].cast("long").alias("lv"), "gap", "exact", "exact_sum", "pred_first", "pred_sub", "err_first", "err_sub").withColumn("level", F.element_at(F.array(*[F.lit(float(v)) for v in levels]), F.col("lv").cast("int") + 1))


def validity_scan(edges: DataFrame, nodes: DataFrame, safety: float = 0.5, limit: int | None = None, **field) -> tuple[DataFrame, DataFrame]:
    """(per-graph rho, one summary row): rho = norm of the mean reduction Laplacian over the gap."""
    from ..plans.ordered import quantiles
    from .spectrum import lap_norm, spectral_gap

    if limit is not None:
        ids = nodes.select(G).distinct().orderBy(G).limit(limit)
        edges, nodes = edges.join(ids, G, "left_semi"), nodes.join(ids, G, "left_semi")
    f = perturbation_field(edges, nodes, **field)
    r = lap_norm(f, nodes).join(spectral_gap(edges, nodes), G).select(G, (F.col("norm") / F.greatest("gap", F.lit(1e-12))).alias("rho"))
    from ..plans.lineage import cut

    r = cut(r)
    med = quantiles(r.withColumn("one", F.lit(1)), ["one"], "rho", {"rho_median": 0.5})
    s = r.withColumn("one", F.lit(1)).groupBy("one").agg(
        F.count(F.lit(1)).alias("n_scanned"), F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"), F.avg((F.col("rho") <= safety).cast("double")).alias("share_inside")
    )
    return r, s.join(med, "one").drop("one")


def scaling_exponent(gaps: DataFrame, key: str) -> DataFrame:
    """Slope of ln(median gap over seeds) on ln(n) per key, from (key, n, seed, gap); NULL with fewer than two sizes."""
    from ..plans.ordered import quantiles

    med = quantiles(gaps, [key, "n"], "gap", {"gap": 0.5}).where("gap > 0 and gap < double('inf')")
    s = med.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.regr_slope(F.log("gap"), F.log("n")).alias("slope"))
    return s.select(key, F.when(F.col("c") >= 2, F.col("slope")).alias("slope"))


def resolution_change(rows: DataFrame) -> DataFrame:
    """Relative change of lambda2 between successive targets of a graph; a graph has few targets."""
    prev = F.lag("lambda2").over(Window.partitionBy(G).orderBy("target"))
    return rows.withColumn("rel_change", F.abs(F.col("lambda2") - prev) / F.greatest(F.abs(prev), F.lit(1e-12)))


# ---- node fields -----------------------------------------------------------------------------


def node_grad(edges: DataFrame, nodes: DataFrame, col: str, name: str = "grad") -> DataFrame:
    """Mean |difference| of a node field over incident edges; 0 for isolated nodes."""
    e = endpoints(edges.select(G, "src", "dst"), nodes, [col])
    d = F.abs(F.col(f"{col}_s") - F.col(f"{col}_d"))
    per = e.select(G, d.alias("d"), F.explode(F.array("src", "dst")).alias("node_id")).groupBy(G, "node_id").agg(F.avg("d").alias(name))
    return nodes.select(G, "node_id").join(per, [G, "node_id"], "left").na.fill({name: 0.0})


def hotspot(edges: DataFrame, nodes: DataFrame, phi: DataFrame | None = None, per: DataFrame | None = None) -> DataFrame:
    """Gradient of phi2 times the Perron entry."""
    phi = fiedler(edges, nodes) if phi is None else phi
    per = perron(edges, nodes) if per is None else per
    g = node_grad(edges, phi, "phi", "grad_phi2")
    return g.join(per, [G, "node_id"]).select(G, "node_id", "grad_phi2", "perron", (F.col("grad_phi2") * F.col("perron")).alias("hotspot"))


def localizer_fields(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Long form (graph_id, node_id, field, score) of six candidate localisers."""
    wide = hotspot(edges, nodes).join(degree(edges).withColumnRenamed("deg", "wdegree"), [G, "node_id"], "left")
    wide = wide.join(nodes.select(G, "node_id", "fibrosis"), [G, "node_id"]).join(node_grad(edges, nodes, "fibrosis", "fibrosis_grad"), [G, "node_id"])
    wide = wide.withColumnRenamed("hotspot", "combined").na.fill({"wdegree": 0.0})
    return wide.unpivot([G, "node_id"], ["grad_phi2", "perron", "combined", "wdegree", "fibrosis", "fibrosis_grad"], "field", "score")


def vulnerability(edges: DataFrame, nodes: DataFrame, arrival: DataFrame, healthy: bool = False) -> DataFrame:
    """Source-sink mismatch over local wavelength at each node, edges oriented by arrival time."""
    eps = 1e-12
    top = edges.groupBy(G).agg(F.max("w").alias("wmax"))
    e = endpoints(edges.join(top, G), arrival, ["dist"], how="left")
    wn = F.lit(1.0) if healthy else F.when(F.col("wmax") > 0, clip(F.col("w") / F.col("wmax"), eps, 1.0)).otherwise(F.lit(eps))
    ts, td = F.col("dist_s"), F.col("dist_d")
    side = lambda me, mine, other: F.struct(
        F.col(me).alias("node_id"), F.sqrt("wn").alias("cv"),
        F.when(other < mine, F.col("wn")).otherwise(F.lit(0.0)).alias("source"), F.when(mine < other, F.col("wn")).otherwise(F.lit(0.0)).alias("sink"),
    )
    both = e.withColumn("wn", wn).select(G, F.explode(F.array(side("src", ts, td), side("dst", td, ts))).alias("r"))
    s = both.groupBy(G, "r.node_id").agg(F.avg("r.cv").alias("cv"), F.sum("r.source").alias("source"), F.sum("r.sink").alias("sink"))
    j = nodes.select(G, "node_id", "fibrosis").join(s, [G, "node_id"], "left")
    erp = F.lit(1.0) if healthy else F.greatest(1 - F.lit(0.6) * clip(F.col("fibrosis"), 0.0, 1.0), F.lit(eps))
    passed = (F.col("source") > 0) & (F.col("sink") > 0)
    v = F.col("sink") / (F.col("source") + F.lit(eps)) / (F.greatest("cv", F.lit(eps)) * erp)
    return j.select(G, "node_id", F.when(passed, v).otherwise(F.lit(0.0)).alias("vuln"))


def reentry_index(edges: DataFrame, nodes: DataFrame, sites: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Peak vulnerability relative to the healthy twin; origin = peak node (lowest id) when inducible."""
    from ..plans.lineage import cut

    arrival = cut(paths.activation(edges, nodes, sites))
    a = vulnerability(edges, nodes, arrival).groupBy(G).agg(F.max("vuln").alias("peak"), F.max_by("node_id", F.struct(F.col("vuln"), -F.col("node_id"))).alias("top"))
    b = vulnerability(edges, nodes, arrival, healthy=True).groupBy(G).agg(F.max("vuln").alias("healthy"))
    j = nodes.select(G).distinct().join(a, G, "left").join(b, G, "left")
    idx = F.coalesce(F.col("peak") / (F.col("healthy") + F.lit(1e-12)), F.lit(0.0))
    ok = (F.coalesce("peak", F.lit(0.0)) > 0) & (idx >= F.lit(threshold))
    return j.select(G, ok.alias("inducible"), idx.alias("reentry_index"), F.when(ok, F.col("top")).alias("origin"))
