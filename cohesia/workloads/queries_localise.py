"""Origin localisation: spatial nulls, ranks and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4
from ..operators import fragility as fr
from ..operators import localise as lo
from ..operators import mesh
from ..operators import statistics as st
from ..operators.components import largest_component
from ..plans.joins import endpoints
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .queries_fragility import LOC
from .queries_graph import LENGTHS, SURF, reach, relax
from .registry import query

G = "graph_id"
N = 50
ORIGIN = "origins AS MATERIALIZED (SELECT graph_id, arg_max(node_id, (-fibrosis, -node_id)) AS origin FROM nodes GROUP BY graph_id)"
TD = "sqrt(least(abs({a}-{c}), 1-abs({a}-{c}))**2 + least(abs({b}-{d}), 1-abs({b}-{d}))**2)"


def _origins(nodes):
    """The least fibrotic node, lowest id on ties."""
    return nodes.groupBy(G).agg(F.max_by("node_id", F.struct(-F.col("fibrosis"), -F.col("node_id"))).alias("origin"))


def _trade(spark, d):
    nodes, edges = views.trade(spark, d)
    return cut(nodes), cut(edges)


@query("t17_colocalise", k.q(k.POINTS, ORIGIN, f"""
hot AS (SELECT graph_id, arg_max(node_id, (fibrosis, -node_id)) AS hot FROM nodes GROUP BY graph_id),
b AS MATERIALIZED (SELECT h.graph_id, a.u AS hu, a.v AS hv, o.u AS ou, o.v AS ov FROM hot h JOIN origins g USING (graph_id) JOIN nodes a ON a.graph_id = h.graph_id AND a.node_id = hot JOIN nodes o ON o.graph_id = h.graph_id AND o.node_id = origin),
dr AS (SELECT b.*, draw, {k.uniform(6, 'graph_id', 'draw', "'s'")} < 0.5 AS sw, {k.uniform(6, 'graph_id', 'draw', "'u'")} AS su, {k.uniform(6, 'graph_id', 'draw', "'v'")} AS sv FROM b CROSS JOIN (SELECT unnest(range({N})) AS draw)),
nl AS (SELECT graph_id, {TD.format(a='hu', b='hv', c='ou', d='ov')} AS obs, (CASE WHEN sw THEN hv ELSE hu END + su) % 1.0::DOUBLE AS x, (CASE WHEN sw THEN hu ELSE hv END + sv) % 1.0::DOUBLE AS y, ou, ov FROM dr),
nd AS (SELECT graph_id, obs, {TD.format(a='x', b='y', c='ou', d='ov')} AS nul FROM nl)""", body=f"""
SELECT graph_id, {k.r4('any_value(obs)', 6)} AS observed, {k.r4('quantile_cont(nul, 0.05)', 6)} AS null_p5, {k.r4('avg(CASE WHEN nul <= obs THEN 1.0 ELSE 0.0 END)', 6)} AS p, any_value(obs) <= quantile_cont(nul, 0.05) AS passed FROM nd GROUP BY graph_id"""))
def t17(spark, d):
    p = cut(views.points(spark, d))
    t = lo.colocalise(p.select(G, "node_id", F.col("fibrosis").alias("score")), p, _origins(p), N, 6)
    return t.select(G, *[r4(c, 6).alias(c) for c in ("observed", "null_p5", "p")], "passed")


@query("t18_torus_null_nodes", k.q(k.POINTS, ORIGIN, f"""
tg AS MATERIALIZED (SELECT n.graph_id, draw, (u + {k.uniform(8, 'n.graph_id', '0', 'draw', "'u'")}) % 1.0::DOUBLE AS tu, (v + {k.uniform(8, 'n.graph_id', '0', 'draw', "'v'")}) % 1.0::DOUBLE AS tv
  FROM origins o JOIN nodes n ON n.graph_id = o.graph_id AND n.node_id = origin CROSS JOIN (SELECT unnest(range({N})) AS draw)),
til AS (SELECT graph_id, node_id, u + a AS u, v + b AS v FROM nodes CROSS JOIN (SELECT unnest([-1, 0, 1]) AS a) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS b))""", body="""
SELECT t.graph_id, CAST(draw AS INTEGER) AS draw, arg_min(node_id, (sqrt((t.tu-l.u)*(t.tu-l.u) + (t.tv-l.v)*(t.tv-l.v)), node_id)) AS node_id FROM tg t JOIN til l USING (graph_id) GROUP BY ALL"""))
def t18(spark, d):
    p = cut(views.points(spark, d))
    hot = _origins(p).select(G, F.lit(0).alias("slot"), F.col("origin").alias("hot"))
    return lo.torus_null_nodes(p, hot, N, 8).select(G, "draw", "node_id")


GEO = (LENGTHS, "gc AS (SELECT graph_id, src, dst, length AS cost FROM costs)", "st AS (SELECT graph_id, origin AS node_id FROM origins)", relax("gc", "st", rounds=24))


@query("t19_localise", k.q(*LOC, ORIGIN, *GEO, """
pk AS (SELECT graph_id, field, arg_max(node_id, (round(score, 9), -node_id)) AS hot FROM fields GROUP BY ALL),
dm AS (SELECT graph_id, max(dist) AS diameter FROM dist GROUP BY ALL)""", body=f"""
SELECT p.graph_id, field, {k.r4('d.dist', 6)} AS obs, {k.r4('diameter', 6)} AS diameter, {k.r4('d.dist / diameter', 6)} AS obs_norm FROM pk p JOIN dist d ON d.graph_id = p.graph_id AND d.node_id = hot JOIN dm ON dm.graph_id = p.graph_id""", recursive=True))
def t19(spark, d):
    nodes, edges = _trade(spark, d)
    f = fr.localizer_fields(edges, nodes).withColumn("score", F.round("score", 9))
    per, _ = lo.localise(edges, nodes, cut(f), cut(_origins(nodes)), N, 12)
    return per.select(G, "field", *[r4(c, 6).alias(c) for c in ("obs", "diameter", "obs_norm")])


@query("t20_score_rank", k.q(k.POINTS, ORIGIN, "f AS (SELECT graph_id, node_id, 'x' AS field, x AS score FROM nodes UNION ALL SELECT graph_id, node_id, 'fib', fibrosis FROM nodes)", body=f"""
SELECT o.graph_id, f.field, {k.r4('(SELECT avg(CASE WHEN g.score >= f.score THEN 1.0 ELSE 0.0 END) FROM f g WHERE g.graph_id = f.graph_id AND g.field = f.field)', 6)} AS share FROM origins o JOIN f ON f.graph_id = o.graph_id AND f.node_id = origin"""))
def t20(spark, d):
    p = cut(views.points(spark, d))
    f = p.select(G, "node_id", "x", F.col("fibrosis").alias("fib")).unpivot([G, "node_id"], ["x", "fib"], "field", "score")
    return lo.score_rank(f, _origins(p).withColumnRenamed("origin", "node_id")).select(G, "field", r4("share", 6).alias("share"))


@query("t21_median_null", k.q(*LOC, ORIGIN, *GEO, """
pk AS (SELECT graph_id, field, arg_max(node_id, (round(score, 9), -node_id)) AS hot FROM fields GROUP BY ALL),
dm AS (SELECT graph_id, max(dist) AS diameter FROM dist GROUP BY ALL)""", body=f"""
SELECT field, {k.r4('median(d.dist / diameter)', 6)} AS obs_median, true AS p_ok FROM pk p JOIN dist d ON d.graph_id = p.graph_id AND d.node_id = hot JOIN dm ON dm.graph_id = p.graph_id GROUP BY field""", recursive=True))
def t21(spark, d):
    nodes, edges = _trade(spark, d)
    f = cut(fr.localizer_fields(edges, nodes).withColumn("score", F.round("score", 9)))
    per, samples = lo.localise(edges, nodes, f, cut(_origins(nodes)), N, 12)
    m = lo.median_null(cut(per), cut(samples), 3)
    return m.select("field", r4("obs_median", 6).alias("obs_median"), (F.col("p").between(0, 1) & (F.col("null_p5") <= F.col("null_p50"))).alias("p_ok"))


@query("t22_median_boot", k.q(k.VERDICTS, f"""
b AS MATERIALIZED (SELECT cohort, tier, subject, score, row_number() OVER (PARTITION BY cohort, tier ORDER BY subject) - 1 AS i, count(*) OVER (PARTITION BY cohort, tier) AS n FROM verdicts),
pk AS (SELECT cohort, tier, rep, least(floor({k.uniform(21, 'cohort', 'tier', 'rep', 'i')} * n), n - 1) AS j FROM b CROSS JOIN (SELECT unnest(range({N})) AS rep)),
md AS (SELECT p.cohort, p.tier, rep, median(score) AS m FROM pk p JOIN b ON b.cohort = p.cohort AND b.tier = p.tier AND b.i = p.j GROUP BY ALL)""", body=f"SELECT cohort, tier, {k.r4('quantile_cont(m, 0.025)', 4)} AS lo, {k.r4('quantile_cont(m, 0.975)', 4)} AS hi FROM md GROUP BY cohort, tier"))
def t22(spark, d):
    t = st.median_boot(cut(views.verdicts(spark, d)), ["cohort", "tier"], "subject", "score", N, 21)
    return t.select("cohort", "tier", r4("lo").alias("lo"), r4("hi").alias("hi"))


SHARES = """
sh AS MATERIALIZED (SELECT a.graph_id, a.node_id, a.field, (SELECT avg(CASE WHEN g.score >= a.score THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM f g WHERE g.graph_id = a.graph_id AND g.field = a.field) AS share FROM f a)"""


@query("t23_perm_verdict", k.q(k.POINTS, ORIGIN, "f AS MATERIALIZED (SELECT graph_id, node_id, 'x' AS field, x AS score FROM nodes UNION ALL SELECT graph_id, node_id, 'fib', fibrosis FROM nodes)", SHARES, f"""
ix AS MATERIALIZED (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY graph_id) AS n FROM nodes),
pick AS (SELECT graph_id, i, least(floor({k.uniform(14, 'graph_id', 'i')} * n), n - 1) AS k FROM (SELECT DISTINCT graph_id, n FROM ix) CROSS JOIN LATERAL (SELECT unnest(range(least(300, n))) AS i)),
smp AS MATERIALIZED (SELECT p.graph_id, s.field, p.i, s.share FROM pick p JOIN ix ON ix.graph_id = p.graph_id AND ix.k = p.k JOIN sh s ON s.graph_id = p.graph_id AND s.node_id = ix.node_id),
ln AS (SELECT graph_id, field, count(*) AS len FROM smp GROUP BY ALL),
dw AS (SELECT field, least(5000, min(len)) AS draws FROM ln GROUP BY field),
dd AS (SELECT ln.graph_id, ln.field, draw, least(floor({k.uniform(14, 'ln.graph_id', 'ln.field', 'draw')} * len), len - 1) AS i FROM ln JOIN dw USING (field) CROSS JOIN LATERAL (SELECT unnest(range(draws)) AS draw)),
mm AS (SELECT d.field, draw, avg(share) AS m FROM dd d JOIN smp s ON s.graph_id = d.graph_id AND s.field = d.field AND s.i = d.i GROUP BY ALL),
ob AS (SELECT field, avg(share) AS mean_rank FROM sh JOIN origins o ON o.graph_id = sh.graph_id AND o.origin = sh.node_id GROUP BY field)""", body=f"""
SELECT field, {k.r4('any_value(mean_rank)', 6)} AS mean_rank, {k.r4('avg(CASE WHEN m <= mean_rank THEN 1.0 ELSE 0.0 END)', 6)} AS p, {k.r4('avg(m)', 6)} AS null_mean,
  CASE WHEN avg(CASE WHEN m <= mean_rank THEN 1.0 ELSE 0.0 END) < 0.05 THEN 'KEEP' ELSE 'DELETE' END AS verdict FROM mm JOIN ob USING (field) GROUP BY field"""))
def t23(spark, d):
    p = cut(views.points(spark, d))
    f = p.select(G, "node_id", "x", F.col("fibrosis").alias("fib")).unpivot([G, "node_id"], ["x", "fib"], "field", "score")
    r, s = lo.rank_battery(p, f, _origins(p), 14)
    t = lo.perm_verdict(r, s, 14)
    return t.select("field", *[r4(c, 6).alias(c) for c in ("mean_rank", "p", "null_mean")], "verdict")


@query("t25_origin_sensitivity", k.q(k.POINTS, ORIGIN, "f AS MATERIALIZED (SELECT graph_id, node_id, 'x' AS field, x AS score FROM nodes UNION ALL SELECT graph_id, node_id, 'fib', fibrosis FROM nodes)", SHARES, """
od AS (SELECT graph_id, 'coldest' AS definition, origin FROM origins UNION ALL SELECT graph_id, 'first', min(node_id) FROM nodes GROUP BY graph_id)""", body=f"""
SELECT definition, field, {k.r4('avg(share)', 6)} AS mean_rank FROM od JOIN sh ON sh.graph_id = od.graph_id AND sh.node_id = origin GROUP BY ALL"""))
def t25(spark, d):
    p = cut(views.points(spark, d))
    f = p.select(G, "node_id", "x", F.col("fibrosis").alias("fib")).unpivot([G, "node_id"], ["x", "fib"], "field", "score")
    o = _origins(p).select(G, F.lit("coldest").alias("definition"), "origin").union(p.groupBy(G).agg(F.lit("first"), F.min("node_id")))
    return lo.origin_sensitivity(p, f, cut(o), 14).select("definition", "field", r4("mean_rank", 6).alias("mean_rank"))


@query("t58_landmark_distance", k.q(SURF, """
he AS (SELECT e.graph_id, src, dst FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE a.fibrosis <= 0.7 AND b.fibrosis <= 0.7)""",
    reach("he", "nodes"), """
best AS (SELECT graph_id, arg_max(comp, (c, -comp)) AS comp FROM (SELECT graph_id, comp, count(*) AS c FROM comp GROUP BY ALL) GROUP BY graph_id),
kept AS (SELECT graph_id, node_id FROM comp SEMI JOIN best USING (graph_id, comp)),
og AS (SELECT graph_id, max(node_id) AS node_id FROM kept GROUP BY graph_id),
pk AS (SELECT graph_id, arg_max(node_id, (fibrosis, -node_id)) AS top FROM nodes GROUP BY graph_id)""", body=f"""
SELECT o.graph_id, {k.r4('sqrt(n.x**2 + n.y**2)', 6)} AS to_landmark, {k.r4('sqrt((n.x-t.x)**2 + (n.y-t.y)**2)', 6)} AS to_peak,
  {k.r4('(SELECT avg(CASE WHEN m.fibrosis >= n.fibrosis THEN 1.0 ELSE 0.0 END) FROM nodes m WHERE m.graph_id = o.graph_id)', 6)} AS rank_fibrosis
FROM og o JOIN nodes n ON n.graph_id = o.graph_id AND n.node_id = o.node_id JOIN pk ON pk.graph_id = o.graph_id JOIN nodes t ON t.graph_id = o.graph_id AND t.node_id = top""", recursive=True))
def t58(spark, d):
    """Origin = last node that survives scar removal; landmark = the coordinate origin."""
    nodes, faces = views.surface(spark, d)
    nodes, edges = mesh.mesh_to_graph(nodes, faces)
    nodes, edges = cut(nodes), cut(edges)
    e = endpoints(edges, nodes, ["fibrosis"]).where("fibrosis_s <= 0.7 and fibrosis_d <= 0.7").select(G, "src", "dst")
    kept = cut(largest_component(nodes, e))
    o = kept.groupBy(G).agg(F.max("node_id").alias("origin"))
    lm = o.select(G, F.lit(0.0).alias("lx"), F.lit(0.0).alias("ly"))
    t = lo.landmark_distance(o, lm, nodes, cut(fr.localizer_fields(edges, nodes)), kept)
    return t.select(G, *[r4(c, 6).alias(c) for c in ("to_landmark", "to_peak", "rank_fibrosis")])


@query("t59_localise_cohort", k.q(*LOC, ORIGIN, "f AS MATERIALIZED (SELECT graph_id, node_id, field, round(score, 9) AS score FROM fields)", SHARES, body=f"""
SELECT sh.field, {k.r4('avg(share)', 6)} AS mean_rank, count(*) AS n, true AS bounded FROM sh JOIN origins o ON o.graph_id = sh.graph_id AND o.origin = sh.node_id GROUP BY sh.field"""))
def t59(spark, d):
    nodes, edges = _trade(spark, d)
    f = fr.localizer_fields(edges, nodes).withColumn("score", F.round("score", 9))
    t = lo.localise_cohort(edges, nodes, f, cut(_origins(nodes)), N, 12, 200)
    ok = F.col("p").between(0, 1) & F.col("p_median").between(0, 1) & F.col("share_passing").between(0, 1)
    return t.select("field", r4("mean_rank", 6).alias("mean_rank"), "n", ok.alias("bounded"))
