"""Graph algorithms (components, Laplacians, spectra, paths, cuts) over the trade and surface cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4
from ..operators import components as cc
from ..operators import connectivity as cn
from ..operators import fragility as fr
from ..operators import mesh
from ..operators import paths
from ..operators import spectrum as sp
from . import sqlkit as k
from . import views
from .registry import query

G = "graph_id"


def reach(edges: str = "edges", nodes: str = "nodes", name: str = "comp") -> str:
    """Component labels by transitive closure (recursive)."""
    return f"""
{name}_both AS MATERIALIZED (SELECT graph_id, src, dst FROM {edges} UNION SELECT graph_id, dst, src FROM {edges}),
{name}_r AS (SELECT graph_id, node_id, node_id AS lab FROM {nodes}
  UNION SELECT r.graph_id, b.dst, r.lab FROM {name}_r r JOIN {name}_both b ON b.graph_id = r.graph_id AND b.src = r.node_id),
{name} AS MATERIALIZED (SELECT graph_id, node_id, min(lab) AS comp FROM {name}_r GROUP BY ALL)"""


def relax(costs: str, start: str, name: str = "dist", rounds: int = 60) -> str:
    """Shortest distances by `rounds` synchronous relaxations (recursive)."""
    return f"""
{name}_links AS MATERIALIZED (SELECT graph_id, src, dst, cost FROM {costs} UNION ALL SELECT graph_id, dst, src, cost FROM {costs}),
{name}_it AS (SELECT 0 AS it, graph_id, node_id, 0.0::DOUBLE AS d FROM {start}
  UNION ALL SELECT it + 1, graph_id, node_id, min(d) FROM (
    SELECT it, graph_id, node_id, d FROM {name}_it
    UNION ALL SELECT r.it, r.graph_id, l.dst, r.d + l.cost FROM {name}_it r JOIN {name}_links l ON l.graph_id = r.graph_id AND l.src = r.node_id)
  WHERE it < {rounds} GROUP BY it, graph_id, node_id),
{name} AS MATERIALIZED (SELECT graph_id, node_id, min(d) AS dist FROM {name}_it GROUP BY ALL)"""


MESH_EDGES = "edges AS MATERIALIZED (SELECT graph_id, src, dst, w FROM wedges)"
SURF = k.SURFACE.replace("\nedges AS MATERIALIZED", "\nwedges AS MATERIALIZED") + ",\n" + MESH_EDGES
LENGTHS = "costs AS MATERIALIZED (SELECT graph_id, src, dst, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS length, w FROM edges e JOIN nodes a USING (graph_id) JOIN nodes b USING (graph_id) WHERE a.node_id = src AND b.node_id = dst)"


# Orders and pairs first take a neighbour each (a customer, an order's customer), so that labels only travel between those.
_RETAIL_COMPONENTS = k.q(k.RETAIL, """
held AS MATERIALIZED (SELECT dst AS node_id, min(src) AS head FROM edges WHERE dst < 4611686018427387904 AND src IS NOT NULL GROUP BY dst),
lines AS MATERIALIZED (SELECT DISTINCT dst AS node_id, coalesce(head, src) AS head FROM edges LEFT JOIN held ON node_id = src WHERE dst >= 4611686018427387904 AND src IS NOT NULL),
pairs AS MATERIALIZED (SELECT node_id, min(head) AS head FROM lines GROUP BY node_id),
hooks AS (SELECT src AS a, head AS b FROM edges JOIN held ON node_id = dst WHERE src <> head UNION SELECT l.head, p.head FROM lines l JOIN pairs p USING (node_id) WHERE l.head <> p.head),
both_ways AS MATERIALIZED (SELECT a, b FROM hooks UNION SELECT b, a FROM hooks),
lab(node_id, low) USING KEY (node_id) AS (
  SELECT DISTINCT a AS node_id, a AS low FROM both_ways
  UNION SELECT b, min(l.low) FROM lab l JOIN both_ways ON a = l.node_id JOIN recurring.lab r ON r.node_id = b WHERE l.low < r.low GROUP BY b),
heads AS (SELECT n.node_id, coalesce(h.head, p.head, n.node_id) AS head FROM nodes n LEFT JOIN held h ON h.node_id = n.node_id LEFT JOIN pairs p ON p.node_id = n.node_id)""",
    body="""SELECT min(h.node_id) AS comp, count(*) AS members FROM heads h LEFT JOIN lab l ON l.node_id = h.head GROUP BY coalesce(low, head)""", recursive=True)


@query("c01_components", _RETAIL_COMPONENTS)
def c01(spark, d):
    nodes, edges = views.retail(spark, d)
    return cc.components(edges, nodes).groupBy("comp").agg(F.count(F.lit(1)).alias("members"))


@query("c01_components_joined", _RETAIL_COMPONENTS)
def c01j(spark, d):
    """The join route, whatever the size of the graph."""
    nodes, edges = views.retail(spark, d)
    return cc.components(edges, nodes, local_edges=0).groupBy("comp").agg(F.count(F.lit(1)).alias("members"))


@query("c01_components_surface", k.q(SURF, """
hot AS (SELECT graph_id, node_id FROM nodes WHERE fibrosis < 0.5),
he AS (SELECT e.graph_id, src, dst FROM edges e JOIN hot a ON a.graph_id = e.graph_id AND a.node_id = src JOIN hot b ON b.graph_id = e.graph_id AND b.node_id = dst)""",
    reach("he", "hot"), body="SELECT graph_id, node_id, comp FROM comp", recursive=True))
def c01s(spark, d):
    nodes, faces = views.surface(spark, d)
    hot = nodes.where("fibrosis < 0.5").select(G, "node_id")
    e = mesh.mesh_edges(faces)
    e = e.join(hot.withColumnRenamed("node_id", "src"), [G, "src"]).join(hot.withColumnRenamed("node_id", "dst"), [G, "dst"])
    return cc.components(e, hot)


@query("c02_largest_component", k.q(SURF, """
he AS (SELECT e.graph_id, src, dst FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = dst
  WHERE a.fibrosis < 0.4 AND b.fibrosis < 0.4)""", reach("he", "nodes"), """
best AS (SELECT graph_id, arg_max(comp, (c, -comp)) AS comp FROM (SELECT graph_id, comp, count(*) AS c FROM comp GROUP BY ALL) GROUP BY graph_id),
kept AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS new_id FROM comp SEMI JOIN best USING (graph_id, comp))""",
    body="""SELECT h.graph_id, a.new_id AS src, b.new_id AS dst FROM he h JOIN kept a ON a.graph_id = h.graph_id AND a.node_id = src
JOIN kept b ON b.graph_id = h.graph_id AND b.node_id = dst""", recursive=True))
def c02(spark, d):
    from ..plans.joins import endpoints

    nodes, faces = views.surface(spark, d)
    e = endpoints(mesh.mesh_edges(faces), nodes, ["fibrosis"]).where("fibrosis_s < 0.4 and fibrosis_d < 0.4").select(G, "src", "dst")
    return cc.restrict_to_largest(nodes, e)[1]


_LAPS = """
deg AS (SELECT g, i, sum(w) AS d FROM lap_adj GROUP BY ALL)"""


@query("c03_laplacian", k.q(k.TRADE, k.laplacian(), _LAPS, body=f"""
SELECT 'comb' AS kind, g AS graph_id, i, j, {k.r4('v')} AS val FROM lap
UNION ALL SELECT 'sym', a.g, a.i, a.j, {k.r4('-w / sqrt(p.d * q.d)', 8)} FROM lap_adj a JOIN deg p ON p.g = a.g AND p.i = a.i JOIN deg q ON q.g = a.g AND q.i = a.j
UNION ALL SELECT 'rw', a.g, a.i, a.j, {k.r4('-w / p.d', 8)} FROM lap_adj a JOIN deg p ON p.g = a.g AND p.i = a.i
UNION ALL SELECT kd, graph_id, node_id, node_id, 1.0::DOUBLE FROM nodes CROSS JOIN (SELECT unnest(['sym', 'rw']) AS kd)"""))
def c03(spark, d):
    nodes, edges = views.trade(spark, d)
    out = None
    for kind, digits in (("comb", 4), ("sym", 8), ("rw", 8)):
        part = sp.laplacian(edges, nodes, kind).select(F.lit(kind).alias("kind"), G, "i", "j", r4("val", digits).alias("val"))
        out = part if out is None else out.union(part)
    return out


@query("c04_lap_apply", k.q(k.TRADE, k.laplacian(), body=f"""
SELECT l.g AS graph_id, l.i AS node_id, {k.r4('sum(l.v * n.fibrosis)')} AS l_fibrosis, {k.r4('sum(l.v * n.u)')} AS l_u
FROM lap l JOIN nodes n ON n.graph_id = l.g AND n.node_id = l.j GROUP BY ALL"""))
def c04(spark, d):
    nodes, edges = views.trade(spark, d)
    out = sp.lap_apply(edges, nodes.select(G, "node_id", "fibrosis", "u"), ["fibrosis", "u"])
    return out.select(G, "node_id", r4("l_fibrosis").alias("l_fibrosis"), r4("l_u").alias("l_u"))


@query("c04_lap_apply_parts", k.q(k.PARTS, "x AS (SELECT node_id, abs(node_id % 7)::DOUBLE AS x FROM nodes)", body=f"""
SELECT node_id, {k.r4('sum(l)')} AS l_x FROM (
  SELECT src AS node_id, w * (a.x - b.x) AS l FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst
  UNION ALL SELECT dst, w * (b.x - a.x) FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst) GROUP BY ALL"""))
def c04p(spark, d):
    nodes, edges = views.parts(spark, d)
    x = nodes.select(G, "node_id", F.abs(F.col("node_id") % 7).cast("double").alias("x"))
    return sp.lap_apply(edges, x, ["x"]).select("node_id", r4("l_x").alias("l_x"))


@query("c05_smallest_eigpairs", k.q(k.TRADE, k.laplacian(), k.lowest("lap", 4), body=f"""
SELECT g AS graph_id, idx, {k.r4('val', 3)} AS val, true AS converged FROM eig_val"""))
def c05(spark, d):
    nodes, edges = views.trade(spark, d)
    v = sp.eigenvalues(sp.smallest_eigpairs(edges, nodes, 4))
    return v.select(G, "idx", r4("val", 3).alias("val"), (F.col("residual") < 1e-6).alias("converged"))


@query("c05_smallest_eigpairs_surface", k.q(k.SURFACE, body="""
SELECT graph_id, CAST(i AS INTEGER) AS idx, count(*) AS n, true AS converged FROM nodes CROSS JOIN (SELECT unnest(range(3)) AS i) GROUP BY ALL"""))
def c05s(spark, d):
    nodes, faces = views.surface(spark, d)
    nodes, edges = mesh.mesh_to_graph(nodes, faces)
    v = sp.eigenvalues(sp.smallest_eigpairs(edges, nodes, 3))
    return v.select(G, "idx", "n", (F.col("residual") < 1e-5).alias("converged"))


EIG2 = (k.TRADE, k.laplacian(), k.lowest("lap", 2))
EIG3 = (k.TRADE, k.laplacian(), k.lowest("lap", 3))
EIG6 = (k.TRADE, k.laplacian(), k.lowest("lap", 6))
# Algebraically largest eigenpair of W: smallest of -W.
PERRON = ("negw AS MATERIALIZED (SELECT g, i, j, -w AS v FROM lap_adj)", k.lowest("negw", 1, "per"))
FRAG = """
frag AS MATERIALIZED (SELECT e.graph_id, e.src, e.dst, e.w, a.p + b.p - 2 * c.p AS frag FROM edges e
  JOIN eig2 a ON a.g = e.graph_id AND a.i = e.src AND a.j = e.src JOIN eig2 b ON b.g = e.graph_id AND b.i = e.dst AND b.j = e.dst
  JOIN eig2 c ON c.g = e.graph_id AND c.i = e.src AND c.j = e.dst)"""


@query("c06_fiedler", k.q(*EIG2, body=f"""
SELECT p.g AS graph_id, p.i AS node_id, {k.r4('e.val', 3)} AS lambda2, {k.r4('p.p', 5)} AS phi_sq FROM eig2 p JOIN eig_v2 e ON e.g = p.g WHERE p.i = p.j"""))
def c06(spark, d):
    nodes, edges = views.trade(spark, d)
    f = sp.fiedler(edges, nodes)
    return f.select(G, "node_id", r4("lambda2", 3).alias("lambda2"), r4(F.col("phi") * F.col("phi"), 5).alias("phi_sq"))


@query("c07_spectral_gap", k.q(*EIG3, body=f"SELECT a.g AS graph_id, {k.r4('b.val - a.val', 3)} AS gap FROM eig_v2 a JOIN eig_v3 b ON a.g = b.g"))
def c07(spark, d):
    nodes, edges = views.trade(spark, d)
    return sp.spectral_gap(edges, nodes).select(G, r4("gap", 3).alias("gap"))


@query("c08_perron", k.q(k.TRADE, k.laplacian(), *PERRON, body=f"""
SELECT p.g AS graph_id, p.i AS node_id, {k.r4('-e.val', 3)} AS rho, {k.r4('sqrt(greatest(p.p, 0))', 5)} AS perron FROM per1 p JOIN per_v1 e ON e.g = p.g WHERE p.i = p.j"""))
def c08(spark, d):
    nodes, edges = views.trade(spark, d)
    return sp.perron(edges, nodes).select(G, "node_id", r4("rho", 3).alias("rho"), r4("perron", 5).alias("perron"))


FIELD = """
field AS MATERIALIZED (SELECT e.graph_id, src, dst, w, CASE WHEN a.region = b.region THEN a.region ELSE -1 END AS region,
  greatest({mu} * (1 + (a.fibrosis + b.fibrosis) / 2), 0) * w AS dw FROM edges e
  JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = dst)"""


@query("c09_lap_norm", k.q(k.TRADE, FIELD.format(mu=0.15), k.laplacian("field", "nodes", "dl", "dw"), "negd AS MATERIALIZED (SELECT g, i, j, -v AS v FROM dl)", k.lowest("negd", 1, "nrm"),
    body=f"SELECT g AS graph_id, {k.r4('-val', 3)} AS norm FROM nrm_v1"))
def c09(spark, d):
    nodes, edges = views.trade(spark, d)
    return sp.lap_norm(fr.perturbation_field(edges, nodes), nodes).select(G, r4("norm", 3).alias("norm"))


SITES = "sites AS (SELECT graph_id, min(node_id) AS node_id FROM nodes GROUP BY graph_id)"
ACT_COSTS = """
acost AS MATERIALIZED (SELECT graph_id, src, dst, greatest(length, 1e-12) / sqrt(least(greatest(w / max(w) OVER (PARTITION BY graph_id), 1e-12), 1)) AS cost FROM costs)"""


_GEODESIC = k.q(k.SPARSE, LENGTHS, "gc AS (SELECT graph_id, src, dst, length AS cost FROM costs)", SITES, relax("gc", "sites", rounds=24), body=f"""
SELECT n.graph_id, n.node_id, {k.r4('dist')} AS dist FROM nodes n LEFT JOIN dist USING (graph_id, node_id)""", recursive=True)


def _geodesic(spark, d, **route):
    nodes, edges = views.sparse_trade(spark, d)
    sites = nodes.groupBy(G).agg(F.min("node_id").alias("node_id"))
    return paths.geodesic_from(edges, nodes, sites, **route).select(G, "node_id", r4("dist").alias("dist"))


@query("c10_geodesic", _GEODESIC)
def c10(spark, d):
    return _geodesic(spark, d)


@query("c10_geodesic_joined", _GEODESIC)
def c10j(spark, d):
    """The join route, whatever the size of the graphs."""
    return _geodesic(spark, d, local_edges=0)


@query("c11_activation", k.q(SURF, LENGTHS, ACT_COSTS, SITES, relax("acost", "sites", rounds=90), body=f"""
SELECT n.graph_id, n.node_id, {k.r4('dist')} AS dist FROM nodes n LEFT JOIN dist USING (graph_id, node_id)""", recursive=True))
def c11(spark, d):
    nodes, faces = views.surface(spark, d)
    nodes, edges = mesh.mesh_to_graph(nodes, faces)
    sites = nodes.groupBy(G).agg(F.min("node_id").alias("node_id"))
    return paths.activation(edges, nodes, sites).select(G, "node_id", r4("dist").alias("dist"))


@query("c12_activation_multi", k.q(k.SPARSE, LENGTHS, ACT_COSTS, "sites AS (SELECT graph_id, node_id FROM nodes WHERE region = 0)", relax("acost", "sites", rounds=24), body=f"""
SELECT n.graph_id, n.node_id, {k.r4('dist')} AS dist FROM nodes n LEFT JOIN dist USING (graph_id, node_id)""", recursive=True))
def c12(spark, d):
    nodes, edges = views.sparse_trade(spark, d)
    return paths.activation(edges, nodes, nodes.where("region = 0")).select(G, "node_id", r4("dist").alias("dist"))


@query("c13_eccentricity", k.q(k.SPARSE, LENGTHS, "gc AS (SELECT graph_id, src, dst, length AS cost FROM costs)", SITES, relax("gc", "sites", rounds=24), body=f"""
SELECT graph_id, {k.r4('max(dist)')} AS diameter FROM dist GROUP BY ALL""", recursive=True))
def c13(spark, d):
    nodes, edges = views.sparse_trade(spark, d)
    sites = nodes.groupBy(G).agg(F.min("node_id").alias("node_id"))
    return paths.eccentricity(paths.geodesic_from(edges, nodes, sites)).select(G, r4("diameter").alias("diameter"))


def percolation_sql(edges: str = "edges") -> str:
    return f"""
ord AS MATERIALIZED (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id ORDER BY {k.uniform(0, 'graph_id', 'src', 'dst')}, src, dst) - 1 AS pos,
  count(*) OVER (PARTITION BY graph_id) AS m FROM {edges}),
lv AS MATERIALIZED (SELECT o.graph_id || '#' || l AS graph_id, src, dst FROM ord o CROSS JOIN (SELECT unnest(range(26)) AS l) WHERE pos >= round_even(l / 25.0::DOUBLE * m, 0)),
lvn AS MATERIALIZED (SELECT graph_id || '#' || l AS graph_id, node_id FROM nodes CROSS JOIN (SELECT unnest(range(26)) AS l)),""" + reach("lv", "lvn", "pc") + """,
giant AS (SELECT split_part(graph_id, '#', 1) AS graph_id, split_part(graph_id, '#', 2)::INT AS l, max(c) AS g, sum(c) AS n FROM (
  SELECT graph_id, comp, count(*) AS c FROM pc GROUP BY ALL) GROUP BY ALL),
perc AS MATERIALIZED (SELECT graph_id, coalesce(min(CASE WHEN g < 0.5 * n THEN l END) / 25.0::DOUBLE, 1.0::DOUBLE) AS percolation FROM giant GROUP BY ALL)"""


@query("c14_percolation", k.q(k.SPARSE, percolation_sql(), body=f"SELECT graph_id, {k.r4('percolation')} AS percolation FROM perc", recursive=True))
def c14(spark, d):
    nodes, edges = views.sparse_trade(spark, d)
    return cn.percolation(edges, nodes).select(G, r4("percolation").alias("percolation"))


@query("c15_min_cut_exact", k.q(k.TRADE, """
rn AS MATERIALIZED (SELECT graph_id || '/' || region AS graph_id, node_id, row_number() OVER (PARTITION BY graph_id, region ORDER BY node_id) - 1 AS b FROM nodes),
re AS (SELECT a.graph_id, a.b AS p, b.b AS q, w FROM edges e JOIN rn a ON split_part(a.graph_id, '/', 1) = e.graph_id AND a.node_id = src
  JOIN rn b ON b.graph_id = a.graph_id AND b.node_id = dst),
masks AS (SELECT graph_id, unnest(range(1, (2 ** (n - 1))::BIGINT)) AS mask FROM (SELECT graph_id, count(*) AS n FROM rn GROUP BY ALL) WHERE n >= 2),
cuts AS (SELECT m.graph_id, mask, sum(coalesce(CASE WHEN ((mask >> p) & 1) <> ((mask >> q) & 1) THEN w END, 0)) AS cut FROM masks m LEFT JOIN re USING (graph_id) GROUP BY ALL)""",
    body=f"SELECT graph_id, {k.r4('min(cut)')} AS min_cut FROM cuts GROUP BY ALL"))
def c15(spark, d):
    """Trade within a region: at most 16 nodes, so every bipartition is weighed."""
    from ..plans.joins import endpoints

    nodes, edges = views.trade(spark, d)
    key = F.concat_ws("/", G, F.col("region").cast("string"))
    e = endpoints(edges, nodes, ["region"]).where("region_s = region_d").select(F.concat_ws("/", G, F.col("region_s").cast("string")).alias(G), "src", "dst", "w")
    return cn.exact_min_cut(e, nodes.select(key.alias(G), "node_id")).select(G, r4("min_cut").alias("min_cut"))


@query("c15_min_cut_bound", k.q(*EIG2, """
deg AS (SELECT g, i, sum(w) AS d FROM lap_adj GROUP BY ALL)""", body=f"""
SELECT g AS graph_id, true AS under_degree, true AS ordered, {k.r4('any_value(e.val) * (count(*) - 1) / count(*)', 3)} AS lower FROM deg JOIN eig_v2 e USING (g) GROUP BY g"""))
def c15b(spark, d):
    nodes, edges = views.trade(spark, d)
    least = sp.degree(edges).groupBy(G).agg(F.min("deg").alias("least"))
    b = cn.min_cut_bound(edges, nodes).join(least, G)
    return b.select(G, (F.col("value") <= F.col("least") + 1e-9).alias("under_degree"), (F.col("lower") <= F.col("value") + 1e-9).alias("ordered"), r4("lower", 3).alias("lower"))


@query("c16_patch_size", k.q(SURF, """
hot AS (SELECT graph_id, node_id FROM nodes WHERE fibrosis >= 0.5),
he AS (SELECT e.graph_id, src, dst FROM edges e JOIN hot a ON a.graph_id = e.graph_id AND a.node_id = src JOIN hot b ON b.graph_id = e.graph_id AND b.node_id = dst)""",
    reach("he", "hot"), body=f"""
SELECT n.graph_id, {k.r4('coalesce(any_value(p.m), 0)')} AS patch_size FROM nodes n LEFT JOIN (
  SELECT graph_id, avg(c) AS m FROM (SELECT graph_id, comp, count(*) AS c FROM comp GROUP BY ALL) GROUP BY ALL) p USING (graph_id) GROUP BY ALL""", recursive=True))
def c16(spark, d):
    nodes, faces = views.surface(spark, d)
    return cn.patch_size(nodes, mesh.mesh_edges(faces)).select(G, r4("patch_size").alias("patch_size"))


@query("c17_node_grad", k.q(k.TRADE, body=f"""
SELECT n.graph_id, n.node_id, {k.r4('coalesce(avg(abs(n.fibrosis - o.fibrosis)), 0)', 6)} AS grad FROM nodes n
LEFT JOIN (SELECT graph_id, src, dst FROM edges UNION ALL SELECT graph_id, dst, src FROM edges) e ON e.graph_id = n.graph_id AND e.src = n.node_id
LEFT JOIN nodes o ON o.graph_id = e.graph_id AND o.node_id = e.dst GROUP BY ALL"""))
def c17(spark, d):
    nodes, edges = views.trade(spark, d)
    return fr.node_grad(edges, nodes, "fibrosis").select(G, "node_id", r4("grad", 6).alias("grad"))


@query("c18_random_walk", k.q(k.PARTS, """
ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)""", body=f"""
SELECT src, dst, {k.r4('w / sum(w) OVER (PARTITION BY src)', 8)} AS p FROM ways"""))
def c18(spark, d):
    return cn.random_walk(views.parts(spark, d)[1]).select("src", "dst", r4("p", 8).alias("p"))
