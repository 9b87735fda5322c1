"""Do score peaks sit near known origins? Distances, spatial nulls and permutation verdicts per (graph, field)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans.lineage import cut
from ..plans.ordered import midranks, quantiles, row_numbers
from .paths import eccentricity, geodesic_from
from .spatial import knn, torus_tiles

G = "graph_id"
GF = [G, "field"]


def peak(scores: DataFrame, keys: Sequence[str], col: str = "score") -> DataFrame:
    """Highest-scoring node per key, lowest id on ties."""
    return scores.groupBy(*keys).agg(F.max_by("node_id", F.struct(F.col(col), -F.col("node_id"))).alias("hot"))


def torus_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    dx, dy = F.least(dx, 1 - dx), F.least(dy, 1 - dy)
    return F.sqrt(dx * dx + dy * dy)


def _draws(df: DataFrame, n: int, name: str = "draw") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def colocalise(scores: DataFrame, coords: DataFrame, origins: DataFrame, n_null: int, seed: int) -> DataFrame:
    """Torus distance of each graph's peak to its origin against random shifts (half with swapped axes)."""
    at = lambda k, n: coords.select(G, F.col("node_id").alias(k), F.col("u").alias(f"{n}u"), F.col("v").alias(f"{n}v"))
    base = peak(scores, [G]).join(origins, G).join(at("hot", "h"), [G, "hot"]).join(at("origin", "o"), [G, "origin"])
    base = cut(base.withColumn("observed", torus_distance(F.col("hu"), F.col("hv"), F.col("ou"), F.col("ov"))))
    d = _draws(base, n_null)
    swap = uniform(seed, G, "draw", F.lit("s")) < 0.5
    su = F.when(swap, F.col("hv")).otherwise(F.col("hu")) + uniform(seed, G, "draw", F.lit("u"))
    sv = F.when(swap, F.col("hu")).otherwise(F.col("hv")) + uniform(seed, G, "draw", F.lit("v"))
    d = cut(d.select(G, "observed", torus_distance(su % 1.0, sv % 1.0, F.col("ou"), F.col("ov")).alias("null")))
    p5 = quantiles(d, [G], "null", {"null_p5": 0.05}, group_rows=n_null)
    s = d.groupBy(G).agg(F.max("observed").alias("observed"), F.avg((F.col("null") <= F.col("observed")).cast("double")).alias("p"))
    return s.join(p5, G).withColumn("passed", F.col("observed") <= F.col("null_p5"))


def torus_null_nodes(nodes: DataFrame, hot: DataFrame, n_null: int, seed: int) -> DataFrame:
    """(keys of hot, draw, node_id): each peak translated at random on the torus, snapped to the nearest node.

    hot(graph_id, slot, hot): `slot` numbers several peaks of one graph.
    """
    q = _draws(hot.join(nodes.select(G, F.col("node_id").alias("hot"), "u", "v"), [G, "hot"]), n_null)
    q = q.select(G, (F.col("slot") * n_null + F.col("draw")).cast("long").alias("qid"), ((F.col("u") + uniform(seed, G, "slot", "draw", F.lit("u"))) % 1.0).alias("u"), ((F.col("v") + uniform(seed, G, "slot", "draw", F.lit("v"))) % 1.0).alias("v"))
    nn = knn(cut(q), cut(torus_tiles(nodes)), 1, ("u", "v"))
    return nn.select(G, F.floor(F.col("qid") / n_null).cast("int").alias("slot"), (F.col("qid") % n_null).cast("int").alias("draw"), "node_id")


def localise(edges: DataFrame, nodes: DataFrame, fields: DataFrame, origins: DataFrame, n_null: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(per graph and field: observed error, share of diameter, null 5th percentile, percentile; normalised null samples)."""
    geo = cut(geodesic_from(edges, nodes, origins.select(G, F.col("origin").alias("node_id"))))
    names = sorted(r[0] for r in fields.select("field").distinct().collect())  # a handful of field names
    slot = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("field")).cast("int") - 1
    hot = cut(peak(fields, GF).withColumn("slot", slot))
    at = lambda k, n: geo.select(G, F.col("node_id").alias(k), F.col("dist").alias(n))
    obs = hot.join(at("hot", "obs"), [G, "hot"]).join(eccentricity(geo), G)
    nul = torus_null_nodes(nodes, hot.select(G, "slot", "hot"), n_null, seed).join(hot.select(G, "slot", "field"), [G, "slot"])
    nul = cut(nul.join(at("node_id", "d"), [G, "node_id"]).where("d is not null").join(obs.select(*GF, "obs", "diameter"), GF))
    p5 = quantiles(nul, GF, "d", {"null_p5": 0.05}, group_rows=n_null)
    pct = nul.groupBy(*GF).agg(F.avg((F.col("d") <= F.col("obs")).cast("double")).alias("percentile"))
    out = obs.join(p5, GF, "left").join(pct, GF, "left").select(*GF, "hot", "obs", "diameter", F.when(F.col("diameter") > 0, F.col("obs") / F.col("diameter")).alias("obs_norm"), "null_p5", "percentile")
    samples = nul.where("diameter > 0").select(*GF, "draw", (F.col("d") / F.col("diameter")).alias("value"))
    return out, row_numbers(samples, GF, [F.col("draw")], "i", group_rows=n_null).drop("draw")


def score_shares(fields: DataFrame) -> DataFrame:
    """Share of a graph's nodes scoring at least each distinct score, per field."""
    t = midranks(fields, GF, "score", {"__c": F.lit(1)})
    n = fields.groupBy(*GF).agg(F.count(F.lit(1)).alias("__n"))
    return t.join(n, GF).select(*GF, "score", ((F.col("__n") - F.col("__c_below")) / F.col("__n")).alias("share"))


def score_rank(fields: DataFrame, picks: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Rank share of picked nodes picks(graph_id, node_id, ...) in every field."""
    shares = score_shares(fields) if shares is None else shares
    return picks.join(fields, [G, "node_id"]).join(shares, [*GF, "score"])


def random_picks(nodes: DataFrame, at_most: int, seed: int) -> DataFrame:
    """min(at_most, n) nodes per graph with replacement: (graph_id, i, node_id)."""
    idx = cut(row_numbers(nodes.select(G, "node_id"), [G], [F.col("node_id")], "k"))
    n = idx.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    d = n.select(G, "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(at_most), F.col("n")).cast("int") - 1)).alias("i"))
    k = F.least(F.floor(uniform(seed, G, "i") * F.col("n")), F.col("n") - 1).cast("long")
    return d.select(G, "i", k.alias("k")).join(idx, [G, "k"]).select(G, "i", "node_id")


def _one_per_subject(samples: DataFrame, cap: int, seed: int) -> DataFrame:
    """(field, draw, value): each draw takes one stored sample per subject; draws = min(cap, shortest list)."""
    size = cut(samples.groupBy(*GF).agg(F.count(F.lit(1)).alias("len")))
    draws = size.groupBy("field").agg(F.least(F.lit(cap), F.min("len")).alias("draws"))
    d = size.join(draws, "field").where("draws > 0").select(*GF, "len", F.explode(F.sequence(F.lit(0), F.col("draws").cast("int") - 1)).alias("draw"))
    i = F.least(F.floor(uniform(seed, G, "field", "draw") * F.col("len")), F.col("len") - 1).cast("long")
    return d.select(*GF, "draw", i.alias("i")).join(samples.withColumn("i", F.col("i").cast("long")), [*GF, "i"]).select("field", "draw", "value")


def median_null(observed: DataFrame, samples: DataFrame, seed: int, cap: int = 4000) -> DataFrame:
    """Observed cohort median of obs_norm per field against medians of one null sample per subject."""
    obs = quantiles(observed, ["field"], "obs_norm", {"obs_median": 0.5})
    d = cut(quantiles(cut(_one_per_subject(samples, cap, seed)), ["field", "draw"], "value", {"m": 0.5}).join(obs, "field"))
    q = quantiles(d, ["field"], "m", {"null_p5": 0.05, "null_p50": 0.5}, group_rows=cap)
    p = d.groupBy("field").agg(F.avg((F.col("m") <= F.col("obs_median")).cast("double")).alias("p"), F.max("obs_median").alias("obs_median"))
    return p.join(q, "field").withColumn("endpoint_met", F.col("obs_median") < F.col("null_p5"))


def perm_verdict(ranks: DataFrame, samples: DataFrame, seed: int, cap: int = 5000, keys: Sequence[str] = ("field",)) -> DataFrame:
    """Mean origin rank per field against means of one random-node rank per subject; KEEP when p < .05."""
    obs = ranks.groupBy("field").agg(F.avg("share").alias("mean_rank"))
    d = _one_per_subject(samples.withColumnRenamed("share", "value"), cap, seed).groupBy("field", "draw").agg(F.avg("value").alias("m"))
    p = d.join(obs, "field").groupBy("field").agg(F.max("mean_rank").alias("mean_rank"), F.avg((F.col("m") <= F.col("mean_rank")).cast("double")).alias("p"), F.avg("m").alias("null_mean"))
    return p.withColumn("verdict", F.when(F.col("p") < 0.05, "KEEP").otherwise("DELETE"))


def rank_battery(nodes: DataFrame, fields: DataFrame, origins: DataFrame, seed: int, at_most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(origin ranks, random-node rank samples) per graph and field, sharing one rank table."""
    fields = cut(fields)
    shares = cut(score_shares(fields))
    o = score_rank(fields, origins.select(G, F.col("origin").alias("node_id")), shares).select(*GF, "share")
    r = score_rank(fields, random_picks(nodes, at_most, seed), shares).select(*GF, "i", "share")
    return cut(o), cut(r)


def origin_sensitivity(nodes: DataFrame, fields: DataFrame, origins: DataFrame, seed: int, at_most: int = 300) -> DataFrame:
    """Verdict per origin definition and field from origins(graph_id, definition, origin)."""
    fields = cut(fields)
    shares = cut(score_shares(fields))
    tag = F.concat_ws("|", "definition", "field")
    o = score_rank(fields, origins.select(G, "definition", F.col("origin").alias("node_id")), shares).select(G, tag.alias("field"), "share")
    defs = origins.select(G, "definition").distinct()
    r = score_rank(fields, random_picks(nodes, at_most, seed), shares).join(defs, G).select(G, tag.alias("field"), "i", "share")
    v = perm_verdict(cut(o), cut(r), seed)
    part = F.split("field", r"\|")
    return v.select(part[0].alias("definition"), part[1].alias("field"), "mean_rank", "p", "verdict")


def landmark_distance(origins: DataFrame, landmarks: DataFrame, nodes: DataFrame, fields: DataFrame, kept: DataFrame) -> DataFrame:
    """Planar distance of each surviving origin to a landmark and to the fibrosis peak, with its field ranks.

    kept(graph_id, node_id) lists the nodes that survive the subgraph; other origins are dropped.
    """
    o = origins.select(G, F.col("origin").alias("node_id")).join(kept.select(G, "node_id"), [G, "node_id"], "left_semi")
    xy = nodes.select(G, "node_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    top = nodes.groupBy(G).agg(F.max_by(F.struct("x", "y"), F.struct(F.col("fibrosis"), -F.col("node_id"))).alias("pk"))
    ranks = score_rank(fields, o).groupBy(G).pivot("field", ["grad_phi2", "fibrosis"]).agg(F.first("share"))
    j = o.join(xy, [G, "node_id"]).join(landmarks, G).join(top, G).join(ranks, G)
    gap = lambda x, y: F.sqrt((F.col("ox") - x) * (F.col("ox") - x) + (F.col("oy") - y) * (F.col("oy") - y))
    return j.select(G, gap(F.col("lx"), F.col("ly")).alias("to_landmark"), gap(F.col("pk.x"), F.col("pk.y")).alias("to_peak"), F.col("grad_phi2").alias("rank_grad"), F.col("fibrosis").alias("rank_fibrosis"))


def localise_cohort(edges: DataFrame, nodes: DataFrame, fields: DataFrame, origins: DataFrame, n_null: int, seed: int, at_most: int = 300) -> DataFrame:
    """Per field: mean origin rank and permutation verdict, cohort-median endpoint, share of graphs passing their own null."""
    fields = cut(fields)
    per, samples = localise(edges, nodes, fields, origins, n_null, seed)
    per, samples = cut(per), cut(samples)
    ranks, picks = rank_battery(nodes, fields, origins, seed, at_most)
    v = perm_verdict(ranks, picks, seed)
    m = median_null(per, samples, seed).select("field", "obs_median", F.col("null_p5").alias("median_p5"), F.col("p").alias("p_median"), "endpoint_met")
    s = per.groupBy("field").agg(F.avg((F.col("obs") <= F.col("null_p5")).cast("double")).alias("share_passing"), F.count(F.lit(1)).alias("n"))
    return v.join(m, "field").join(s, "field")
