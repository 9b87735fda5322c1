"""Spectral descriptors and fragility over the trade cohort; oracles rebuild eigenprojectors by matrix squaring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4, radius_for_degree, relative_error
from ..operators import features
from ..operators import fragility as fr
from ..operators import mesh, paths
from ..operators import spectrum as sp
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .queries_graph import ACT_COSTS, EIG2, EIG3, EIG6, FIELD, FRAG, LENGTHS, PERRON, SITES, SURF, percolation_sql, reach, relax
from .registry import query

G = "graph_id"
MU = 0.36  # frozen-run mean reduction
SFI = (*EIG2, FRAG, FIELD.format(mu=MU), """
sfi AS MATERIALIZED (SELECT f.graph_id, f.src, f.dst, f.region, f.w, f.dw, g.frag, f.dw * g.frag AS sfi FROM field f JOIN frag g USING (graph_id, src, dst)),
reg AS MATERIALIZED (SELECT graph_id, region, sum(sfi) AS sfi FROM sfi GROUP BY ALL)""")


def _scored(spark, d):
    nodes, edges = views.trade(spark, d)
    return nodes, edges, fr.sfi_edges(edges, nodes, sp.fiedler(edges, nodes), mu=MU)


@query("f01_ipr", k.q(k.TRADE, body=f"SELECT graph_id, {k.r4('sum(fibrosis**4) / sum(fibrosis**2)**2', 6)} AS ipr FROM nodes GROUP BY ALL"))
def f01(spark, d):
    return fr.ipr(views.trade(spark, d)[0], "fibrosis").select(G, r4("ipr", 6).alias("ipr"))


@query("f02_cheeger", k.q(*EIG2, body=f"SELECT g AS graph_id, {k.r4('(val / 2 + sqrt(2 * val)) / 2', 3)} AS cheeger FROM eig_v2"))
def f02(spark, d):
    nodes, edges = views.trade(spark, d)
    return sp.fiedler(edges, nodes).groupBy(G).agg(r4(fr.cheeger(F.max("lambda2")), 3).alias("cheeger"))


LOWSQL = f"""
SELECT g AS graph_id, {k.r4("-sum(CASE WHEN greatest(val, 0) > 0 THEN greatest(val, 0) / tot * ln(greatest(val, 0) / tot) ELSE 0 END)")} AS spectral_entropy,
  count(*) FILTER (val < 1e-9) AS n_near_zero, {k.r4('sum(exp(-greatest(val, 0)))')} AS heat_trace
FROM (SELECT *, sum(greatest(val, 0)) OVER (PARTITION BY g) AS tot FROM eig_val) GROUP BY g"""


def _unit_trade(spark, d):
    """Trade scaled to a mean edge weight of 1/25 per year, so heat traces stay in range."""
    nodes, edges = views.trade(spark, d)
    m = edges.groupBy(G).agg(F.avg("w").alias("m"))
    return nodes, edges.join(m, G).select(G, "src", "dst", (F.col("w") / F.col("m") / 25).alias("w"))


UNIT = k.TRADE.replace("edges AS MATERIALIZED", "raw_edges AS MATERIALIZED").replace("FROM edges", "FROM raw_edges") + """,
edges AS MATERIALIZED (SELECT graph_id, src, dst, w / avg(w) OVER (PARTITION BY graph_id) / 25 AS w FROM raw_edges)"""
UNIT6 = (UNIT, k.laplacian(), k.lowest("lap", 6))
# The zero mode of the oracle is only as small as round-off, so it is pinned to exactly 0.
PIN = "eig_pin AS MATERIALIZED (SELECT g, idx, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE val END AS val FROM eig_val)"


@query("f03_spectral_entropy", k.q(*UNIT6, PIN, body=LOWSQL.replace("FROM eig_val", "FROM eig_pin")))
def f03(spark, d):
    nodes, edges = _unit_trade(spark, d)
    out = fr.low_spectrum(sp.smallest_eigpairs(edges, nodes, 6))
    return out.select(G, r4("spectral_entropy").alias("spectral_entropy"), "n_near_zero", r4("heat_trace").alias("heat_trace"))


@query("f04_near_zero", k.q(k.TRADE, reach(), body="SELECT graph_id, count(DISTINCT comp) AS n_near_zero FROM comp GROUP BY ALL", recursive=True))
def f04(spark, d):
    nodes, edges = _unit_trade(spark, d)
    return fr.low_spectrum(sp.smallest_eigpairs(edges, nodes, 6)).select(G, "n_near_zero")


@query("f05_heat_trace", k.q(*UNIT6, PIN, body=f"SELECT g AS graph_id, {k.r4('sum(exp(-2 * val))')} AS heat_trace FROM eig_pin GROUP BY g"))
def f05(spark, d):
    nodes, edges = _unit_trade(spark, d)
    return fr.low_spectrum(sp.smallest_eigpairs(edges, nodes, 6), t=2.0).select(G, r4("heat_trace").alias("heat_trace"))


@query("f06_spectral_features", k.q(*UNIT6, PIN, *PERRON, f"low AS ({LOWSQL.replace('FROM eig_val', 'FROM eig_pin')})", body=f"""
SELECT l.*, {k.r4('e3.val - e2.val')} AS gap, {k.r4('(e2.val / 2 + sqrt(2 * e2.val)) / 2')} AS cheeger, {k.r4('e2.val')} AS lambda2,
  {k.r4('(SELECT sum(p * p) / sum(p)**2 FROM per1 WHERE g = l.graph_id AND i = j)')} AS perron_ipr,
  {k.r4('(SELECT sum(p * p) FROM eig2 WHERE g = l.graph_id AND i = j)')} AS fiedler_ipr,
  {k.r4('(SELECT avg(sqrt(greatest(p, 0))) FROM eig2 WHERE g = l.graph_id AND i = j)')} AS fiedler_abs_mean,
  {k.r4('(SELECT max(sqrt(greatest(p, 0))) FROM eig2 WHERE g = l.graph_id AND i = j)')} AS fiedler_abs_max
FROM low l JOIN eig_v2 e2 ON e2.g = l.graph_id JOIN eig_v3 e3 ON e3.g = l.graph_id"""))
def f06(spark, d):
    nodes, edges = _unit_trade(spark, d)
    out = fr.spectral_features(edges, nodes)
    return out.select(*[c if c in (G, "n_near_zero") else r4(c).alias(c) for c in out.columns])


@query("f07_edge_fragility", k.q(*EIG2, FRAG, body=f"SELECT graph_id, src, dst, {k.r4('frag', 5)} AS frag FROM frag"))
def f07(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.edge_fragility(edges, sp.fiedler(edges, nodes)).select(G, "src", "dst", r4("frag", 5).alias("frag"))


@query("f08_perturbation_field", k.q(k.TRADE, FIELD.format(mu=0.15), body=f"SELECT graph_id, src, dst, {k.r4('dw', 6)} AS dw, {k.r4('0.25 * dw * dw', 6)} AS var FROM field"))
def f08(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.perturbation_field(edges, nodes).select(G, "src", "dst", r4("dw", 6).alias("dw"), r4("var", 6).alias("var"))


@query("f09_edge_region", k.q(k.TRADE, FIELD.format(mu=0.15), body="SELECT graph_id, src, dst, CAST(region AS BIGINT) AS region FROM field"))
def f09(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.perturbation_field(edges, nodes).select(G, "src", "dst", "region")


@query("f10_sfi_region", k.q(*SFI, body=f"SELECT graph_id, CAST(region AS BIGINT) AS region, {k.r4('sfi', 4)} AS sfi FROM reg"))
def f10(spark, d):
    _, _, s = _scored(spark, d)
    return fr.sfi_region(s).select(G, "region", r4("sfi", 4).alias("sfi"))


@query("f11_sfi_features", k.q(*SFI, """
top AS (SELECT graph_id, list(sfi ORDER BY sfi DESC) AS t FROM reg GROUP BY ALL)""", body=f"""
SELECT r.graph_id, {k.r4('sum(sfi)')} AS total, {k.r4('max(sfi)')} AS region_max, {k.r4('avg(sfi)')} AS region_mean, {k.r4('stddev_pop(sfi)')} AS region_std,
  {k.r4('coalesce(any_value(t)[1], 0)')} AS top1, {k.r4('coalesce(any_value(t)[2], 0)')} AS top2, {k.r4('coalesce(any_value(t)[3], 0)')} AS top3,
  {k.r4('(SELECT max(frag) FROM frag f WHERE f.graph_id = r.graph_id)')} AS edge_frag_max, {k.r4('(SELECT avg(frag) FROM frag f WHERE f.graph_id = r.graph_id)')} AS edge_frag_mean
FROM reg r JOIN top USING (graph_id) GROUP BY r.graph_id"""))
def f11(spark, d):
    nodes, edges = views.trade(spark, d)
    out = fr.sfi_features(edges, nodes, mu=MU)
    return out.select(*[c if c == G else r4(c).alias(c) for c in out.columns])


DRAWS = 8
_ERL = " + ".join(f"(-ln(1 - {k.uniform(11, 'graph_id', 'src', 'dst', 'draw', str(i))}))" for i in range(4))
DRAWN = f"""
drawn AS MATERIALIZED (SELECT graph_id, src, dst, draw, least(({_ERL}) / 4 * dw, 0.999 * w) AS d FROM field CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw))"""


@query("f12_sample_dw", k.q(k.TRADE, FIELD.format(mu=MU), DRAWN, body=f"SELECT graph_id, src, dst, CAST(draw AS INTEGER) AS draw, {k.r4('d')} AS drop FROM drawn"))
def f12(spark, d):
    nodes, edges = views.trade(spark, d)
    s = fr.sample_dw(fr.perturbation_field(edges, nodes, mu=MU), DRAWS, 11)
    return s.select(G, "src", "dst", "draw", r4("drop").alias("drop"))


_ERLR = _ERL.replace("CAST(draw AS VARCHAR)", "region_key || '|' || CAST(draw AS VARCHAR)")
VARIANT = """
vw AS MATERIALIZED (SELECT v.graph_id || '#' || v.variant AS graph_id, e.src, e.dst, e.w - coalesce(t.drop, 0) AS w
  FROM (SELECT DISTINCT graph_id, variant FROM tagged) v JOIN edges e ON e.graph_id = v.graph_id
  LEFT JOIN tagged t ON t.graph_id = v.graph_id AND t.variant = v.variant AND t.src = e.src AND t.dst = e.dst),
vn AS MATERIALIZED (SELECT v.graph_id || '#' || v.variant AS graph_id, node_id FROM (SELECT DISTINCT graph_id, variant FROM tagged) v JOIN nodes USING (graph_id))""" + "," + k.laplacian("vw", "vn", "vlap")


@query("f13_sfi_monte_carlo", k.q(*EIG2, FIELD.format(mu=0.15), f"""
fr AS (SELECT *, unnest([CAST(region AS VARCHAR), '_all']) AS region_key FROM field),
tagged AS MATERIALIZED (SELECT graph_id, region_key || '@' || draw AS variant, src, dst, least(({_ERLR}) / 4 * dw, 0.999 * w) AS drop FROM fr CROSS JOIN (SELECT unnest(range(4)) AS draw))""",
    VARIANT, k.lowest("vlap", 2, "ve", 13), """
res AS (SELECT split_part(v.g, '#', 1) AS graph_id, split_part(split_part(v.g, '#', 2), '@', 1) AS region, b.val - v.val AS d FROM ve_v2 v JOIN eig_v2 b ON b.g = split_part(v.g, '#', 1))""",
    body=f"SELECT graph_id, region, {k.r4('avg(d)', 2)} AS mean, {k.r4('stddev_samp(d)', 2)} AS std, count(*) AS cnt FROM res GROUP BY ALL"))
def f13(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.sfi_monte_carlo(edges, nodes, 4, 11).select(G, "region", r4("mean", 2).alias("mean"), r4("std", 2).alias("std"), "cnt")


NORM = ("negd AS MATERIALIZED (SELECT g, i, j, -v AS v FROM dl)", k.lowest("negd", 1, "nrm"))


@query("f14_validity", k.q(*EIG3, FIELD.format(mu=0.15), k.laplacian("field", "nodes", "dl", "dw"), *NORM, body="""
SELECT a.g AS graph_id, (-n.val) <= 0.5 * (b.val - a.val) AS valid FROM eig_v2 a JOIN eig_v3 b ON a.g = b.g JOIN nrm_v1 n ON n.g = a.g"""))
def f14(spark, d):
    nodes, edges = views.trade(spark, d)
    j = sp.lap_norm(fr.perturbation_field(edges, nodes), nodes).join(sp.spectral_gap(edges, nodes), G)
    return j.select(G, fr.validity_ok(F.col("norm"), F.col("gap")).alias("valid"))


FRAG3 = FRAG.replace("frag AS MATERIALIZED", "frag3 AS MATERIALIZED").replace("eig2", "eig3").replace("AS frag FROM", "AS frag FROM")
SUB = FRAG3 + ",\nsubf AS MATERIALIZED (SELECT a.graph_id, a.src, a.dst, a.w, a.frag AS f1, a.frag + b.frag AS f2 FROM frag a JOIN frag3 b USING (graph_id, src, dst))"


@query("f15_subspace_sfi", k.q(*EIG3, FRAG, SUB, FIELD.format(mu=MU), body=f"""
SELECT graph_id, src, dst, {k.r4('dw * f2', 4)} AS sfi FROM subf JOIN field USING (graph_id, src, dst)"""))
def f15(spark, d):
    nodes, edges = views.trade(spark, d)
    pairs = sp.smallest_eigpairs(edges, nodes, 3)
    f = fr.subspace_fragility(fr.perturbation_field(edges, nodes, mu=MU), pairs, 2)
    return f.select(G, "src", "dst", r4(F.col("dw") * F.col("frag"), 4).alias("sfi"))


@query("f16_exact_delta", k.q(*EIG2, """
tagged AS MATERIALIZED (SELECT graph_id, unnest([CAST(src AS VARCHAR), CAST(dst AS VARCHAR)]) AS variant, src, dst, w / 2 AS drop FROM edges)""", VARIANT, k.lowest("vlap", 2, "ve", 13),
    body=f"SELECT split_part(v.g, '#', 1) AS graph_id, split_part(v.g, '#', 2) AS variant, {k.r4('v.val - b.val', 3)} AS delta FROM ve_v2 v JOIN eig_v2 b ON b.g = split_part(v.g, '#', 1)"))
def f16(spark, d):
    """Halve all links of a nation, one nation at a time."""
    nodes, edges = views.trade(spark, d)
    ed = edges.select(G, F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("variant"), "src", "dst", (-F.col("w") / 2).alias("dw"))
    return fr.exact_delta(edges, nodes, ed).select(G, "variant", r4("delta", 3).alias("delta"))


@query("f17_exact_region_delta", k.q(*EIG2, FIELD.format(mu=MU), """
tagged AS MATERIALIZED (SELECT graph_id, unnest([CAST(region AS VARCHAR), '_all']) AS variant, src, dst, dw AS drop FROM field)""", VARIANT, k.lowest("vlap", 2, "ve", 13),
    body=f"SELECT split_part(v.g, '#', 1) AS graph_id, split_part(v.g, '#', 2) AS region, {k.r4('b.val - v.val', 3)} AS drop FROM ve_v2 v JOIN eig_v2 b ON b.g = split_part(v.g, '#', 1)"))
def f17(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.exact_region_delta(edges, nodes, mu=MU).select(G, "region", r4("drop", 3).alias("drop"))


HOT = (*EIG2, FRAG, *PERRON, """
gradphi AS MATERIALIZED (SELECT graph_id, node_id, avg(sqrt(greatest(frag, 0))) AS grad FROM (
  SELECT graph_id, src AS node_id, frag FROM frag UNION ALL SELECT graph_id, dst, frag FROM frag) GROUP BY ALL),
hot AS MATERIALIZED (SELECT graph_id, node_id, grad, sqrt(greatest(p.p, 0)) AS perron, grad * sqrt(greatest(p.p, 0)) AS hotspot
  FROM gradphi JOIN per1 p ON p.g = graph_id AND p.i = node_id AND p.j = node_id)""")


@query("f18_hotspot", k.q(*HOT, body=f"SELECT graph_id, node_id, {k.r4('hotspot')} AS hotspot FROM hot"))
def f18(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.hotspot(edges, nodes).select(G, "node_id", r4("hotspot").alias("hotspot"))


LOC = (*HOT, """
wdeg AS (SELECT g, i, sum(w) AS d FROM lap_adj GROUP BY ALL),
fgrad AS (SELECT n.graph_id, n.node_id, avg(abs(n.fibrosis - o.fibrosis)) AS grad FROM nodes n JOIN lap_adj e ON e.g = n.graph_id AND e.i = n.node_id
  JOIN nodes o ON o.graph_id = e.g AND o.node_id = e.j GROUP BY ALL),
fields AS MATERIALIZED (SELECT graph_id, node_id, 'grad_phi2' AS field, grad AS score FROM hot UNION ALL SELECT graph_id, node_id, 'perron', perron FROM hot
  UNION ALL SELECT graph_id, node_id, 'combined', hotspot FROM hot UNION ALL SELECT g, i, 'wdegree', d FROM wdeg
  UNION ALL SELECT graph_id, node_id, 'fibrosis', fibrosis FROM nodes UNION ALL SELECT graph_id, node_id, 'fibrosis_grad', grad FROM fgrad)""")


@query("f19_localizer_fields", k.q(*LOC, body=f"SELECT graph_id, node_id, field, {k.r4('score')} AS score FROM fields"))
def f19(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.localizer_fields(edges, nodes).select(G, "node_id", "field", r4("score").alias("score"))


@query("f20_baseline_features", k.q(k.SPARSE, k.laplacian(), k.lowest("lap", 2), percolation_sql(), """
h AS (SELECT graph_id, least(floor(fibrosis * 16), 15) AS b, count(*) AS c FROM nodes GROUP BY ALL),
ent AS (SELECT graph_id, -sum(c / t * ln(c / t)) / ln(16) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY graph_id) AS t FROM h) GROUP BY graph_id)""",
    body=f"""
SELECT n.graph_id, {k.r4('avg(fibrosis)')} AS burden, {k.r4('any_value(entropy)')} AS entropy, {k.r4('any_value(percolation)')} AS percolation,
  {k.r4('any_value(e.val)', 3)} AS lambda2 FROM nodes n JOIN ent USING (graph_id) JOIN perc USING (graph_id) JOIN eig_v2 e ON e.g = n.graph_id GROUP BY n.graph_id""", recursive=True))
def f20(spark, d):
    nodes, edges = views.sparse_trade(spark, d)
    nodes, edges = cut(nodes), cut(edges)
    return features.baseline_features(edges, nodes).select(G, r4("burden").alias("burden"), r4("entropy").alias("entropy"), r4("percolation").alias("percolation"), r4("lambda2", 3).alias("lambda2"))


@query("f21_burden", k.q(k.POINTS, body=f"SELECT graph_id, {k.r4('avg(fibrosis)', 6)} AS burden FROM nodes GROUP BY ALL"))
def f21(spark, d):
    return fr.burden(views.points(spark, d)).select(G, r4("burden", 6).alias("burden"))


@query("f22_field_entropy", k.q(k.POINTS, """
h AS (SELECT graph_id, least(floor(fibrosis * 16), 15) AS b, count(*) AS c FROM nodes GROUP BY ALL)""", body=f"""
SELECT graph_id, {k.r4('-sum(c / t * ln(c / t)) / ln(16)', 6)} AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY graph_id) AS t FROM h) GROUP BY graph_id"""))
def f22(spark, d):
    return fr.field_entropy(views.points(spark, d)).select(G, r4("entropy", 6).alias("entropy"))


@query("f23_relative_error", k.q(k.VERDICTS, body=f"""
SELECT subject, tier, {k.r4('CASE WHEN abs(cov) >= 1e-12 THEN abs(score - cov) / abs(cov) END', 3)} AS err FROM verdicts"""))
def f23(spark, d):
    v = views.verdicts(spark, d)
    return v.select("subject", "tier", r4(relative_error(F.col("score"), F.col("cov")), 3).alias("err"))


GRID = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.55, 0.75, 0.95)
STEPS = "steps AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(GRID)) + ") s(step, t))"
SWEEP = (*EIG3, FRAG, SUB, STEPS, """
firsts AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS pos FROM subf),
tagged AS MATERIALIZED (SELECT graph_id, step AS variant, t, src, dst, t * w AS drop, f1, f2 FROM firsts CROSS JOIN steps WHERE pos <= 3)""", VARIANT, k.lowest("vlap", 3, "ve", 13),
    "dw AS MATERIALIZED (SELECT graph_id || '#' || variant AS graph_id, src, dst, drop AS dw FROM tagged)", k.laplacian("dw", "vn", "dl", "dw"), *NORM, """
sweep AS MATERIALIZED (SELECT p.graph_id, p.t, -n.val / (b3.val - b2.val) AS rho, b2.val - v2.val AS exact, b2.val + b3.val - v2.val - v3.val AS exact_sum, p1, p2 FROM (
  SELECT graph_id, variant, t, sum(drop * f1) AS p1, sum(drop * f2) AS p2 FROM tagged GROUP BY ALL) p
  JOIN eig_v2 b2 ON b2.g = p.graph_id JOIN eig_v3 b3 ON b3.g = p.graph_id JOIN ve_v2 v2 ON v2.g = p.graph_id || '#' || p.variant
  JOIN ve_v3 v3 ON v3.g = v2.g JOIN nrm_v1 n ON n.g = v2.g)""")


@query("f24_validity_sweep", k.q(*SWEEP, body=f"""
SELECT graph_id, t, {k.r4('rho', 3)} AS rho, {k.r4('exact', 3)} AS exact, {k.r4('exact_sum', 3)} AS exact_sum, {k.r4('p1', 3)} AS pred_first, {k.r4('p2', 3)} AS pred_sub, true AS weyl_ok FROM sweep"""))
def f24(spark, d):
    nodes, edges = views.trade(spark, d)
    s = fr.validity_sweep(cut(edges), cut(nodes), GRID)
    return s.select(G, "t", *[r4(c, 3).alias(c) for c in ("rho", "exact", "exact_sum", "pred_first", "pred_sub")], "weyl_ok")


@query("f24_rho_star", k.q(*SWEEP, body=f"""
SELECT graph_id, {k.r4('arg_min(rho, t) FILTER (abs(p1 - exact) / abs(exact) > 0.1)', 3)} AS rho_star FROM sweep GROUP BY graph_id"""))
def f24r(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.rho_star(fr.validity_sweep(cut(edges), cut(nodes), GRID)).select(G, r4("rho_star", 3).alias("rho_star"))


@query("f25_degeneracy_sweep", k.q(k.TRADE.replace("\nedges AS MATERIALIZED", "\nte AS MATERIALIZED").replace("FROM edges", "FROM te"), f"""
tn AS (SELECT * FROM nodes),
lvl AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 0.3::DOUBLE), (2, 0.1::DOUBLE)) s(lv, level)),
hits AS (SELECT e.*, a.region <> b.region AS bridge, {k.uniform(0, 'e.graph_id', 'src', 'dst')} < 0.2 AS hit FROM te e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = dst),
edges AS MATERIALIZED (SELECT graph_id || '~' || lv AS graph_id, src, dst, CASE WHEN bridge THEN w * level ELSE w END AS w, hit FROM hits CROSS JOIN lvl),
ln AS MATERIALIZED (SELECT graph_id || '~' || lv AS graph_id, node_id FROM tn CROSS JOIN lvl)""", k.laplacian("edges", "ln"), k.lowest("lap", 3), FRAG, SUB, """
tagged AS MATERIALIZED (SELECT s.graph_id, 0 AS variant, s.src, s.dst, 0.2::DOUBLE * s.w AS drop, f1, f2 FROM subf s JOIN edges e USING (graph_id, src, dst) WHERE hit)""",
    VARIANT.replace("JOIN nodes USING", "JOIN ln USING"), k.lowest("vlap", 3, "ve", 14), body=f"""
SELECT split_part(p.graph_id, '~', 1) AS graph_id, CAST(split_part(p.graph_id, '~', 2) AS BIGINT) AS lv, {k.r4('b2.val - v2.val', 2)} AS exact,
  {k.r4('b2.val + b3.val - v2.val - v3.val', 2)} AS exact_sum, {k.r4('p1', 2)} AS pred_first, {k.r4('p2', 2)} AS pred_sub
FROM (SELECT graph_id, sum(drop * f1) AS p1, sum(drop * f2) AS p2 FROM tagged GROUP BY ALL) p JOIN eig_v2 b2 ON b2.g = p.graph_id JOIN eig_v3 b3 ON b3.g = p.graph_id
JOIN ve_v2 v2 ON v2.g = p.graph_id || '#0' JOIN ve_v3 v3 ON v3.g = v2.g"""))
def f25(spark, d):
    """Links between regions are the bridges; they shrink level by level."""
    from ..plans.joins import endpoints

    nodes, edges = views.trade(spark, d)
    e = cut(endpoints(edges, nodes, ["region"]).select(G, "src", "dst", "w", (F.col("region_s") != F.col("region_d")).alias("bridge")))
    s = fr.degeneracy_sweep(e, cut(nodes), "bridge", (1.0, 0.3, 0.1))
    return s.select(G, "lv", *[r4(c, 2).alias(c) for c in ("exact", "exact_sum", "pred_first", "pred_sub")])


@query("f26_validity_scan", k.q(*EIG3, FIELD.format(mu=0.15), k.laplacian("field", "nodes", "dl", "dw"), *NORM, """
r AS (SELECT -n.val / greatest(b.val - a.val, 1e-12) AS rho FROM eig_v2 a JOIN eig_v3 b ON a.g = b.g JOIN nrm_v1 n ON n.g = a.g)""", body=f"""
SELECT count(*) AS n_scanned, {k.r4('median(rho)', 3)} AS rho_median, {k.r4('min(rho)', 3)} AS rho_min, {k.r4('max(rho)', 3)} AS rho_max, {k.r4('avg(CASE WHEN rho <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS share_inside FROM r"""))
def f26(spark, d):
    nodes, edges = views.trade(spark, d)
    s = fr.validity_scan(cut(edges), cut(nodes))[1]
    return s.select("n_scanned", *[r4(c, 3).alias(c) for c in ("rho_median", "rho_min", "rho_max")], r4("share_inside").alias("share_inside"))


@query("f27_scaling_exponent", k.q(k.VERDICTS, """
s AS (SELECT cohort, cnt AS n, tier, avg(score) AS gap FROM verdicts GROUP BY ALL),
m AS (SELECT cohort, n, median(gap) AS gap FROM s GROUP BY ALL)""", body=f"SELECT cohort, {k.r4('regr_slope(ln(gap), ln(n))', 5)} AS slope FROM m GROUP BY cohort"))
def f27(spark, d):
    """Sizes are order counts, seeds are years, the measured quantity is the mean order price."""
    v = views.verdicts(spark, d).groupBy("cohort", F.col("cnt").alias("n"), "tier").agg(F.avg("score").alias("gap"))
    return fr.scaling_exponent(v, "cohort").select("cohort", r4("slope", 5).alias("slope"))


@query("f28_resolution_change", k.q(k.TRADE, FIELD.format(mu=0.15), """
lvls AS (SELECT * FROM (VALUES (1), (2), (3)) s(target)),
le AS MATERIALIZED (SELECT graph_id || '@' || target AS graph_id, src, dst, w FROM edges CROSS JOIN lvls WHERE (src + dst) % 4 < target + 1),
lnn AS MATERIALIZED (SELECT graph_id || '@' || target AS graph_id, node_id FROM nodes CROSS JOIN lvls)""", k.laplacian("le", "lnn"), k.lowest("lap", 2), """
r AS (SELECT split_part(g, '@', 1) AS graph_id, CAST(split_part(g, '@', 2) AS INTEGER) AS target, val FROM eig_v2)""", body=f"""
SELECT graph_id, target, {k.r4('val', 3)} AS lambda2, {k.r4('abs(val - lag(val) OVER w) / greatest(abs(lag(val) OVER w), 1e-12)', 3)} AS rel_change FROM r WINDOW w AS (PARTITION BY graph_id ORDER BY target)"""))
def f28(spark, d):
    """Three nested densities of the same network stand for three resolutions."""
    nodes, edges = views.trade(spark, d)
    lv = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("target")
    key = F.concat_ws("@", G, F.col("target").cast("string"))
    e = edges.select(G, "src", "dst", "w", lv).where("(src + dst) % 4 < target + 1").select(key.alias(G), "src", "dst", "w")
    n = nodes.select(G, "node_id", lv).select(key.alias(G), "node_id")
    f = sp.fiedler(e, n).groupBy(G).agg(F.max("lambda2").alias("lambda2"))
    f = f.select(F.split(G, "@")[0].alias(G), F.split(G, "@")[1].cast("int").alias("target"), "lambda2")
    return fr.resolution_change(f).select(G, "target", r4("lambda2", 3).alias("lambda2"), r4("rel_change", 3).alias("rel_change"))


def vuln_sql(name: str, healthy: bool) -> str:
    w = "1.0::DOUBLE" if healthy else "least(greatest(w / max(w) OVER (PARTITION BY graph_id), 1e-12), 1)"
    erp = "1.0::DOUBLE" if healthy else "(1 - 0.6 * n.fibrosis)"
    return f"""
{name}_e AS MATERIALIZED (SELECT graph_id, src, dst, {w} AS wn FROM edges),
{name}_b AS (SELECT e.graph_id, src AS node_id, wn, a.dist AS mine, b.dist AS other FROM {name}_e e LEFT JOIN dist a ON a.graph_id = e.graph_id AND a.node_id = src
    LEFT JOIN dist b ON b.graph_id = e.graph_id AND b.node_id = dst
  UNION ALL SELECT e.graph_id, dst, wn, b.dist, a.dist FROM {name}_e e LEFT JOIN dist a ON a.graph_id = e.graph_id AND a.node_id = src
    LEFT JOIN dist b ON b.graph_id = e.graph_id AND b.node_id = dst),
{name}_s AS (SELECT graph_id, node_id, avg(sqrt(wn)) AS cv, sum(CASE WHEN other < mine THEN wn ELSE 0 END) AS so, sum(CASE WHEN mine < other THEN wn ELSE 0 END) AS si FROM {name}_b GROUP BY ALL),
{name} AS MATERIALIZED (SELECT n.graph_id, n.node_id, CASE WHEN so > 0 AND si > 0 THEN si / (so + 1e-12) / (cv * {erp}) ELSE 0 END AS vuln FROM nodes n LEFT JOIN {name}_s USING (graph_id, node_id))"""


ARRIVE = (LENGTHS, ACT_COSTS, SITES, relax("acost", "sites", rounds=90))


@query("f29_vulnerability", k.q(SURF, *ARRIVE, vuln_sql("vu", False), body=f"SELECT graph_id, node_id, {k.r4('vuln', 3)} AS vuln FROM vu", recursive=True))
def f29(spark, d):
    nodes, faces = views.surface(spark, d)
    nodes, edges = mesh.mesh_to_graph(nodes, faces)
    edges = cut(edges)
    arrival = paths.activation(edges, nodes, nodes.groupBy(G).agg(F.min("node_id").alias("node_id")))
    return fr.vulnerability(edges, nodes, cut(arrival)).select(G, "node_id", r4("vuln", 3).alias("vuln"))


@query("f30_reentry_index", k.q(SURF, *ARRIVE, vuln_sql("vu", False), vuln_sql("vh", True), """
a AS (SELECT graph_id, max(vuln) AS peak, arg_max(node_id, (vuln, -node_id)) AS top FROM vu GROUP BY ALL),
h AS (SELECT graph_id, max(vuln) AS healthy FROM vh GROUP BY ALL)""", body=f"""
SELECT graph_id, {k.r4('peak / (healthy + 1e-12)', 3)} AS reentry_index, peak > 0 AND peak / (healthy + 1e-12) >= 2.5 AS inducible,
  CASE WHEN peak > 0 AND peak / (healthy + 1e-12) >= 2.5 THEN top ELSE -1 END AS origin FROM a JOIN h USING (graph_id)""", recursive=True))
def f30(spark, d):
    nodes, faces = views.surface(spark, d)
    nodes, edges = mesh.mesh_to_graph(nodes, faces)
    sites = nodes.groupBy(G).agg(F.min("node_id").alias("node_id"))
    return fr.reentry_index(cut(edges), nodes, sites).select(G, r4("reentry_index", 3).alias("reentry_index"), "inducible", F.coalesce("origin", F.lit(-1)).alias("origin"))
