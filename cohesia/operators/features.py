"""Composed per-graph feature vectors: the baseline columns and the namespaced blocks of a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import connectivity as cn
from . import fragility as fr
from . import models as md
from . import spectrum as sp

G = "graph_id"


def baseline_features(edges: DataFrame, nodes: DataFrame, patch_at: float = 0.5) -> DataFrame:
    """Six-column baseline vector; the min cut column is its upper bound."""
    l2 = sp.fiedler(edges, nodes).groupBy(G).agg(F.max("lambda2").alias("lambda2"))
    out = fr.burden(nodes).join(fr.field_entropy(nodes), G).join(cn.patch_size(nodes, edges, patch_at), G)
    bound = cn.min_cut_bound(edges, nodes).select(G, F.col("value").alias("min_cut"))
    return out.join(bound, G).join(cn.percolation(edges, nodes), G).join(l2, G)


def subject_features(edges: DataFrame, nodes: DataFrame, mu: float, exact: bool = False) -> DataFrame:
    """Namespaced long features (graph_id, name, value): heterogeneity, connectivity, spectral and fragility blocks.

    `exact` adds the block of exact re-solved drops, one extra graph a region.
    """
    pairs = sp.smallest_eigpairs(edges, nodes, 6)
    phi = sp.fiedler(edges, nodes, pairs)
    base = baseline_features(edges, nodes)
    out = md.long_features(base.select(G, "burden", "entropy", "patch_size"), "fibhet_").union(md.long_features(base.select(G, "min_cut", "percolation", "lambda2"), "conn_"))
    out = out.union(md.long_features(fr.spectral_features(edges, nodes, pairs=pairs), "spec_")).union(md.long_features(fr.sfi_features(edges, nodes, phi, mu=mu), "sfi_"))
    sub = fr.subspace_fragility(fr.perturbation_field(edges, nodes, mu=mu), pairs, 2)
    sub = sub.groupBy(G, "region").agg(F.sum(F.col("dw") * F.col("frag")).alias("sfi"))
    out = out.union(md.long_features(fr.region_summary(sub, "sfi"), "sfisub_"))
    if exact:
        ex = fr.exact_region_delta(edges, nodes, mu=mu)
        s = fr.region_summary(ex.where("region <> '_all'"), "drop").drop("total").join(ex.where("region = '_all'").select(G, F.col("drop").alias("total")), G)
        out = out.union(md.long_features(s, "sfiex_"))
    return out
