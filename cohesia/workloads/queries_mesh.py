"""Surface, field and graph-construction operators over the embedding patches and point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions.fields import r4
from ..functions.rng import uniform
from ..operators import components as cc
from ..operators import mesh, spatial
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .queries_graph import SURF, reach
from .registry import query

G = "graph_id"
S = k.SURFACE


def _surf(spark, d):
    nodes, faces = views.surface(spark, d)
    return nodes, faces


@query("g01_mesh_edges", k.q(S, body="SELECT graph_id, src, dst FROM mesh_edges"))
def g01(spark, d):
    return mesh.mesh_edges(_surf(spark, d)[1])


@query("g02_edge_length", k.q(S, body=f"SELECT graph_id, src, dst, {k.r4('length', 6)} AS length FROM ends"))
def g02(spark, d):
    nodes, faces = _surf(spark, d)
    return mesh.edge_length(mesh.mesh_edges(faces), nodes).withColumn("length", r4("length", 6))


@query("g03_edge_weights", k.q(S, body=f"SELECT graph_id, src, dst, {k.r4('w', 6)} AS w FROM edges"))
def g03(spark, d):
    nodes, faces = _surf(spark, d)
    return mesh.edge_weights(mesh.mesh_edges(faces), nodes).withColumn("w", r4("w", 6))


@query("g04_mesh_to_graph", k.q(S, body=f"""
SELECT n.graph_id, n.node_id, n.region, {k.r4('n.fibrosis', 6)} AS fibrosis, {k.r4('coalesce(sum(w), 0)')} AS deg FROM nodes n
LEFT JOIN (SELECT graph_id, src, w FROM edges UNION ALL SELECT graph_id, dst, w FROM edges) e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL"""))
def g04(spark, d):
    from ..operators.spectrum import degree

    nodes, edges = mesh.mesh_to_graph(*_surf(spark, d))
    return nodes.join(degree(edges), [G, "node_id"], "left").select(G, "node_id", "region", r4("fibrosis", 6).alias("fibrosis"), r4(F.coalesce("deg", F.lit(0.0))).alias("deg"))


@query("g05_attenuated_weights", k.q(S, body=f"SELECT graph_id, src, dst, {k.r4('least(greatest(1 - (fs + fd) / 2, 0.05), 1)', 6)} AS w FROM ends"))
def g05(spark, d):
    nodes, faces = _surf(spark, d)
    return mesh.attenuated_weights(mesh.mesh_edges(faces), nodes).withColumn("w", r4("w", 6))


@query("g06_cut_edges", k.q(k.TRADE, body=f"SELECT graph_id, src, dst, {k.r4('CASE WHEN (src + dst) % 7 = 0 THEN 0 ELSE w END')} AS w FROM edges"))
def g06(spark, d):
    edges = cut(views.trade(spark, d)[1])
    return mesh.cut_edges(edges, edges.where("(src + dst) % 7 = 0")).withColumn("w", r4("w"))


@query("g07_ramp", k.q(S, body=f"SELECT graph_id, node_id, {k.r4('least(greatest((intensity - 1.0) / 0.32, 0), 1)', 6)} AS fib FROM nodes"))
def g07(spark, d):
    return _surf(spark, d)[0].select(G, "node_id", r4(fx.ramp(F.col("intensity")), 6).alias("fib"))


TAGS = {1: 0.5, 3: 1.0, 5: 0.25, 7: 0.75}


@query("g08_cell_scalar_to_vertex", k.q(S, body=f"""
SELECT graph_id, node_id, {k.r4('avg(CASE tag WHEN 1 THEN 0.5 WHEN 3 THEN 1.0 WHEN 5 THEN 0.25 WHEN 7 THEN 0.75 ELSE 0.0 END)', 6)} AS value FROM corners GROUP BY ALL"""))
def g08(spark, d):
    return mesh.cell_scalar_to_vertex(_surf(spark, d)[1], TAGS).withColumn("value", r4("value", 6))


VERTVEC = """
cv AS MATERIALIZED (SELECT graph_id, node_id, avg(vx) AS mx, avg(vy) AS my, avg(vz) AS mz FROM corners GROUP BY ALL),
vv AS MATERIALIZED (SELECT n.graph_id, n.node_id, CASE WHEN l > 1e-12 THEN mx / l ELSE 1.0 END AS gx, CASE WHEN l > 1e-12 THEN my / l ELSE 0.0 END AS gy, CASE WHEN l > 1e-12 THEN mz / l ELSE 0.0 END AS gz
  FROM nodes n LEFT JOIN (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS l FROM cv) c USING (graph_id, node_id))"""


@query("g09_cell_vector_to_vertex", k.q(S, VERTVEC, body=f"SELECT graph_id, node_id, {k.r4('gx', 6)} AS fx, {k.r4('gy', 6)} AS fy, {k.r4('gz', 6)} AS fz FROM vv"))
def g09(spark, d):
    nodes, faces = _surf(spark, d)
    return mesh.cell_vector_to_vertex(faces, nodes).select(G, "node_id", *[r4(f"f{c}", 6).alias(f"f{c}") for c in "xyz"])


DROP = """
kept AS MATERIALIZED (SELECT * FROM faces WHERE tag NOT IN (2, 4)),
used AS (SELECT graph_id, a AS node_id FROM kept UNION SELECT graph_id, b FROM kept UNION SELECT graph_id, c FROM kept),
rid AS MATERIALIZED (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS nid FROM used)"""


@query("g10_drop_faces", k.q(S, DROP, body="""
SELECT f.graph_id, f.face_id, a.nid AS a, b.nid AS b, c.nid AS c FROM kept f JOIN rid a ON a.graph_id = f.graph_id AND a.node_id = f.a
JOIN rid b ON b.graph_id = f.graph_id AND b.node_id = f.b JOIN rid c ON c.graph_id = f.graph_id AND c.node_id = f.c"""))
def g10(spark, d):
    _, faces, _ = mesh.drop_faces(*_surf(spark, d), [2, 4])
    return faces.select(G, "face_id", "a", "b", "c")


@query("g11_assert_tags", k.q(S, body="SELECT graph_id, count(*) AS faces FROM faces WHERE tag <> 2 GROUP BY ALL"))
def g11(spark, d):
    """The guard passes once the dead tag 2 is in the drop list; raising is covered by tests."""
    faces = cut(_surf(spark, d)[1])
    mesh.assert_tags(faces, [2], [2])
    return faces.where("tag <> 2").groupBy(G).agg(F.count(F.lit(1)).alias("faces"))


@query("g12_vector_spread", k.q(S, body=f"""
SELECT graph_id, {k.r4('avg(sqrt((fx-mx)**2 + (fy-my)**2 + (fz-mz)**2))', 6)} AS spread, avg(sqrt((fx-mx)**2 + (fy-my)**2 + (fz-mz)**2)) < 1e-6 AS degenerate
FROM (SELECT *, avg(fx) OVER w AS mx, avg(fy) OVER w AS my, avg(fz) OVER w AS mz FROM nodes WINDOW w AS (PARTITION BY graph_id)) GROUP BY graph_id"""))
def g12(spark, d):
    return mesh.vector_spread(_surf(spark, d)[0]).withColumn("spread", r4("spread", 6))


@query("g13_tag_fractions", k.q(S, body=f"""
SELECT graph_id, tag, count(*) AS cnt, {k.r4('count(*) / sum(count(*)) OVER (PARTITION BY graph_id)', 6)} AS share FROM faces GROUP BY graph_id, tag"""))
def g13(spark, d):
    return mesh.tag_fractions(_surf(spark, d)[1]).withColumn("share", r4("share", 6))


def grid_sql(u="u", v="v", na=3, nb=3):
    c = lambda x, n: f"floor(least(greatest({x}, 0), 1 - 1e-12::DOUBLE) * {n})"
    return f"CAST({c(v, nb)} * {na} + {c(u, na)} AS BIGINT)"


@query("g14_grid_region", k.q(k.POINTS, body=f"SELECT graph_id, node_id, {grid_sql()} AS r33, {grid_sql(na=2)} AS r23, {grid_sql(na=4, nb=4)} AS r44 FROM nodes"))
def g14(spark, d):
    u, v = F.col("u"), F.col("v")
    return views.points(spark, d).select(G, "node_id", fx.grid_region(u, v).alias("r33"), fx.grid_region(u, v, 2, 3).alias("r23"), fx.grid_region(u, v, 4, 4).alias("r44"))


_COV = ["xx", "xy", "xz", "yy", "yz", "zz"]
PCA = """
cov AS (SELECT graph_id AS g, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, var_pop(y) AS yy, covar_pop(y,z) AS yz, var_pop(z) AS zz FROM nodes GROUP BY ALL),
neg AS MATERIALIZED (SELECT g, unnest([0,0,0,1,1,1,2,2,2]) AS i, unnest([0,1,2,0,1,2,0,1,2]) AS j, -unnest([xx,xy,xz,xy,yy,yz,xz,yz,zz]) AS v FROM cov)""" + "," + k.lowest("neg", 2, "pc", 18) + """,
ax AS MATERIALIZED (SELECT a.g, a.t, list(a.p / sqrt(m.p) ORDER BY a.i) AS c FROM (SELECT 1 AS t, * FROM pc1 UNION ALL SELECT 2, * FROM pc2) a
  JOIN (SELECT g, t, arg_max(i, p) AS i, max(p) AS p FROM (SELECT 1 AS t, * FROM pc1 UNION ALL SELECT 2, * FROM pc2) WHERE i = j GROUP BY g, t) m ON m.g = a.g AND m.t = a.t AND m.i = a.j GROUP BY a.g, a.t),
pr AS (SELECT n.graph_id, n.node_id, (x-mx)*a.c[1] + (y-my)*a.c[2] + (z-mz)*a.c[3] AS p, (x-mx)*b.c[1] + (y-my)*b.c[2] + (z-mz)*b.c[3] AS q
  FROM nodes n JOIN cov ON cov.g = graph_id JOIN ax a ON a.g = graph_id AND a.t = 1 JOIN ax b ON b.g = graph_id AND b.t = 2),
chart AS MATERIALIZED (SELECT graph_id, node_id, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS u, (q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w) AS v FROM pr WINDOW w AS (PARTITION BY graph_id))"""


@query("g15_pca_chart", k.q(k.POINTS, PCA, body=f"SELECT graph_id, node_id, {k.r4('u', 5)} AS u, {k.r4('v', 5)} AS v FROM chart"))
def g15(spark, d):
    p = views.points(spark, d)
    return mesh.pca_chart(p).select(G, "node_id", r4("u", 5).alias("u"), r4("v", 5).alias("v"))


@query("g16_unit_scaling", k.q(S, body=f"SELECT graph_id, node_id, {k.r4('x * 1e-3', 8)} AS x, {k.r4('y * 1e-3', 8)} AS y, {k.r4('z * 1e3', 4)} AS z FROM nodes"))
def g16(spark, d):
    n = _surf(spark, d)[0].select(G, "node_id", *fx.scale(["x", "y"], 1e-3), *fx.scale(["z"], 1e3))
    return n.select(G, "node_id", r4("x", 8).alias("x"), r4("y", 8).alias("y"), r4("z").alias("z"))


COARSE_TARGET = 60
COARSE = f"""
box AS (SELECT graph_id, count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x)-min(x), 1e-9) AS ex, greatest(max(y)-min(y), 1e-9) AS ey, greatest(max(z)-min(z), 1e-9) AS ez FROM nodes GROUP BY ALL),
un AS MATERIALIZED (SELECT n.*, (x-lx)/ex AS gx, (y-ly)/ey AS gy, (z-lz)/ez AS gz FROM nodes n JOIN box USING (graph_id)),
occ AS MATERIALIZED (SELECT graph_id, res, count(DISTINCT (least(floor(gx*res), res-1), least(floor(gy*res), res-1), least(floor(gz*res), res-1))) AS cnt FROM un CROSS JOIN (SELECT unnest(range(2, 513)) AS res) GROUP BY ALL),
bis AS (SELECT graph_id, 0 AS it, 2 AS lo, 512 AS hi, 257 AS res, false AS done FROM box
  UNION ALL SELECT graph_id, it + 1, nlo, nhi, CASE WHEN fin THEN res ELSE (nlo + nhi) // 2 END, fin FROM (
    SELECT b.*, CASE WHEN cnt < {COARSE_TARGET} THEN b.res + 1 ELSE lo END AS nlo, CASE WHEN cnt > {int(COARSE_TARGET * 1.15)} THEN b.res - 1 ELSE hi END AS nhi,
      (cnt BETWEEN {COARSE_TARGET} AND {int(COARSE_TARGET * 1.15)}) OR (CASE WHEN cnt < {COARSE_TARGET} THEN b.res + 1 ELSE lo END > CASE WHEN cnt > {int(COARSE_TARGET * 1.15)} THEN b.res - 1 ELSE hi END) AS fin
    FROM bis b JOIN occ o ON o.graph_id = b.graph_id AND o.res = b.res WHERE NOT done AND it < 24)),
fin AS (SELECT graph_id, arg_max(res, it) AS res FROM bis GROUP BY ALL),
mem AS MATERIALIZED (SELECT u.*, dense_rank() OVER (PARTITION BY u.graph_id ORDER BY least(floor(gx*res), res-1), least(floor(gy*res), res-1), least(floor(gz*res), res-1)) - 1 AS cid FROM un u JOIN fin USING (graph_id)),
cf AS MATERIALIZED (SELECT DISTINCT graph_id, list_sort([p, q, r]) AS t FROM (SELECT f.graph_id, a.cid AS p, b.cid AS q, c.cid AS r FROM faces f
  JOIN mem a ON a.graph_id = f.graph_id AND a.node_id = f.a JOIN mem b ON b.graph_id = f.graph_id AND b.node_id = f.b JOIN mem c ON c.graph_id = f.graph_id AND c.node_id = f.c) WHERE p <> q AND q <> r AND p <> r),
ce AS (SELECT graph_id, t[1] AS src, t[2] AS dst FROM cf UNION SELECT graph_id, t[2], t[3] FROM cf UNION SELECT graph_id, t[1], t[3] FROM cf),
cnodes AS MATERIALIZED (SELECT graph_id, cid AS node_id, avg(x) AS x, avg(fibrosis) AS fib, avg(u) AS u, avg(v) AS v, sum(fx) / sqrt(sum(fx)**2 + sum(fy)**2 + sum(fz)**2) AS fx FROM mem GROUP BY ALL)"""


@query("g17_coarsen", k.q(S, COARSE, reach("ce", "cnodes", "cc"), """
best AS (SELECT graph_id, arg_max(comp, (c, -comp)) AS comp FROM (SELECT graph_id, comp, count(*) AS c FROM cc GROUP BY ALL) GROUP BY graph_id),
kid AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS nid FROM cc SEMI JOIN best USING (graph_id, comp))""",
    body=f"SELECT graph_id, nid AS node_id, {k.r4('x', 5)} AS x, {k.r4('fib', 5)} AS fibrosis, {k.r4('fx', 5)} AS fx, {grid_sql()} AS region FROM cnodes JOIN kid USING (graph_id, node_id)", recursive=True))
def g17(spark, d):
    nodes, _ = mesh.coarsen(*_surf(spark, d), COARSE_TARGET)
    return nodes.select(G, "node_id", r4("x", 5).alias("x"), r4("fibrosis", 5).alias("fibrosis"), r4("fx", 5).alias("fx"), "region")


NORMALS = """
vs AS (SELECT graph_id, node_id, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT graph_id, a AS node_id, nx, ny, nz FROM fpts UNION ALL SELECT graph_id, b, nx, ny, nz FROM fpts UNION ALL SELECT graph_id, c, nx, ny, nz FROM fpts) GROUP BY ALL),
vn AS MATERIALIZED (SELECT graph_id, node_id, coalesce(sx / nullif(l, 0), 0) AS nx, coalesce(sy / nullif(l, 0), 0) AS ny, coalesce(sz / nullif(l, 0), 0) AS nz
  FROM nodes LEFT JOIN (SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS l FROM vs) USING (graph_id, node_id))"""


@query("g18_vertex_normals", k.q(S, NORMALS, body=f"SELECT graph_id, node_id, {k.r4('nx', 5)} AS nx, {k.r4('ny', 5)} AS ny, {k.r4('nz', 5)} AS nz FROM vn"))
def g18(spark, d):
    return mesh.vertex_normals(*_surf(spark, d)).select(G, "node_id", *[r4(f"n{c}", 5).alias(f"n{c}") for c in "xyz"])


@query("g19_tangent_field", k.q(S, NORMALS, body=f"""
SELECT graph_id, node_id, {k.r4('tx / l', 5)} AS fx, {k.r4('ty / l', 5)} AS fy, {k.r4('tz / l', 5)} AS fz FROM (SELECT *, CASE WHEN tx*tx+ty*ty+tz*tz > 0 THEN sqrt(tx*tx+ty*ty+tz*tz) ELSE 1 END AS l FROM (
  SELECT graph_id, node_id, CASE WHEN m < 1e-6 THEN 1 - nx*nx ELSE -nz*nx END AS tx, CASE WHEN m < 1e-6 THEN -nx*ny ELSE -nz*ny END AS ty, CASE WHEN m < 1e-6 THEN -nx*nz ELSE 1 - nz*nz END AS tz
  FROM (SELECT *, sqrt((nz*nx)**2 + (nz*ny)**2 + (1 - nz*nz)**2) AS m FROM vn)))"""))
def g19(spark, d):
    n = mesh.vertex_normals(*_surf(spark, d))
    return mesh.tangent_field(n).select(G, "node_id", *[r4(f"f{c}", 5).alias(f"f{c}") for c in "xyz"])


@query("g20_spherical_chart", k.q(k.POINTS, "p AS (SELECT *, sqrt((x-.5)**2 + (y-.5)**2 + (z-.5)**2) AS r FROM nodes)", body=f"""
SELECT graph_id, node_id, {k.r4('(atan2((y-.5)/r, (x-.5)/r) + pi()) / (2 * pi())', 6)} AS alpha, {k.r4('acos(least(greatest((z-.5)/r, -1), 1)) / pi()', 6)} AS beta FROM p"""))
def g20(spark, d):
    p = views.points(spark, d)
    c = [F.col(k_) - 0.5 for k_ in "xyz"]
    r = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    a, b = fx.spherical_chart(c[0] / r, c[1] / r, c[2] / r)
    return p.select(G, "node_id", r4(a, 6).alias("alpha"), r4(b, 6).alias("beta"))


@query("g21_kernel_field", k.q(k.POINTS, f"""
cen AS (SELECT graph_id, x AS cx, y AS cy, z AS cz, 0.5 + 0.5 * {k.uniform(5, 'graph_id', 'node_id')} AS amp FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {k.uniform(3, 'graph_id', 'node_id')}, node_id) AS p FROM nodes) WHERE p <= 4),
sg AS (SELECT graph_id, greatest(0.2 * sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2), 1e-9) AS s FROM nodes GROUP BY ALL),
raw AS (SELECT n.graph_id, n.node_id, sum(amp * exp(-((x-cx)**2 + (y-cy)**2 + (z-cz)**2) / (2*s*s))) AS f FROM nodes n JOIN cen USING (graph_id) JOIN sg USING (graph_id) GROUP BY ALL)""",
    body=f"SELECT graph_id, node_id, {k.r4('least(greatest(f * 0.3 / avg(f) OVER (PARTITION BY graph_id), 0), 1)', 5)} AS field FROM raw"))
def g21(spark, d):
    p = cut(views.points(spark, d))
    c = mesh.sample_nodes(p, 4, 3).join(p, [G, "node_id"]).select(G, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (0.5 + 0.5 * uniform(5, G, "node_id")).alias("amp"))
    return mesh.kernel_field(p, c, 0.3, sigma_scale=0.2).select(G, "node_id", r4("field", 5).alias("field"))


@query("g22_rescale_mean", k.q(S, body=f"SELECT graph_id, node_id, {k.r4('least(greatest(fibrosis * 0.2 / avg(fibrosis) OVER (PARTITION BY graph_id), 0), 1)', 6)} AS fibrosis FROM nodes"))
def g22(spark, d):
    return mesh.rescale_mean(_surf(spark, d)[0], 0.2).select(G, "node_id", r4("fibrosis", 6).alias("fibrosis"))


@query("g23_quantise", k.q(S, """
t AS (SELECT graph_id, list(fibrosis ORDER BY fibrosis) AS l, (count(*) - 1) * (1 - avg(fibrosis)) AS pos FROM nodes GROUP BY ALL),
c AS (SELECT graph_id, l[floor(pos)::INT + 1] + (pos - floor(pos)) * (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) AS th FROM t)""",
    body="SELECT graph_id, node_id, CAST(fibrosis > 0.5 AS DOUBLE) AS half, CAST(fibrosis > th AS DOUBLE) AS matched FROM nodes JOIN c USING (graph_id)"))
def g23(spark, d):
    n = cut(_surf(spark, d)[0].select(G, "node_id", "fibrosis"))
    a = mesh.quantise_half(n).select(G, "node_id", F.col("fibrosis").alias("half"))
    return a.join(mesh.quantise_burden(n).select(G, "node_id", F.col("fibrosis").alias("matched")), [G, "node_id"])


@query("g24_field_bins", k.q(S, body=f"""
SELECT graph_id, node_id, CAST(least(greatest(floor(fibrosis * 8), 0), 7) AS BIGINT) + 1 AS bin, {k.r4('(least(greatest(floor(fibrosis * 8), 0), 7) + 0.5) / 8')} AS centre FROM nodes"""))
def g24(spark, d):
    b = fx.field_bin(F.col("fibrosis"), 8)
    return _surf(spark, d)[0].select(G, "node_id", b.alias("bin"), r4(fx.bin_centre(b, 8)).alias("centre"))


@query("g25_radius_graph", k.q(k.POINTS, body=f"""
SELECT a.graph_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id
WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.12"""))
def g25(spark, d):
    return spatial.radius_graph(views.points(spark, d), 0.12)


@query("g26_knn", k.q(k.POINTS, """
c AS (SELECT a.graph_id, a.node_id AS qid, b.node_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, qid ORDER BY dist, node_id) AS rank FROM c)""",
    body=f"SELECT graph_id, qid, CAST(rank AS INTEGER) AS rank, node_id, {k.r4('dist', 6)} AS dist FROM r WHERE rank <= 5"))
def g26(spark, d):
    p = cut(views.points(spark, d))
    nn = spatial.knn(p.withColumnRenamed("node_id", "qid"), p, 5, ("x", "y", "z"), skip_self=True)
    return nn.withColumn("dist", r4("dist", 6))


@query("g27_radius_for_degree", k.q(k.POINTS, "r AS (SELECT graph_id, sqrt(6.0::DOUBLE / (count(*) * pi())) AS r FROM nodes GROUP BY ALL)", body=f"""
SELECT a.graph_id, {k.r4('any_value(r)', 6)} AS radius, count(b.node_id) AS pairs FROM nodes a JOIN r USING (graph_id)
LEFT JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= r GROUP BY a.graph_id"""))
def g27(spark, d):
    p = views.points(spark, d)
    n = p.groupBy(G).agg(fx.radius_for_degree(F.count(F.lit(1)), 2, 6.0).alias("radius"))
    p = cut(p.join(n, G))
    pairs = spatial.radius_pairs(p, F.col("radius")).groupBy(G).agg(F.count(F.lit(1)).alias("pairs"))
    return n.join(pairs, G, "left").select(G, r4("radius", 6).alias("radius"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


GEOM = """
geo AS MATERIALIZED (SELECT graph_id, sum(sqrt(nx*nx+ny*ny+nz*nz) / 2) AS area, avg((sqrt((bx-ax)**2+(by_-ay)**2+(bz-az)**2) + sqrt((cx-bx)**2+(cy-by_)**2+(cz-bz)**2) + sqrt((cx-ax)**2+(cy-ay)**2+(cz-az)**2)) / 3) AS mean_edge FROM fpts GROUP BY ALL),
gs AS MATERIALIZED (SELECT graph_id, count(*) AS n_nodes, avg(fibrosis) AS mean_fib, avg(CASE WHEN fibrosis > 0.5 THEN 1.0 ELSE 0.0 END) AS share_half, quantile_cont(fibrosis, 0.9) AS p90_fib FROM nodes GROUP BY ALL)"""


@query("g28_geometry_summary", k.q(S, GEOM, body=f"""
SELECT graph_id, n_nodes, {k.r4('mean_fib')} AS mean_fib, {k.r4('share_half')} AS share_half, {k.r4('area')} AS area, {k.r4('mean_edge')} AS mean_edge, {k.r4('p90_fib')} AS p90_fib FROM gs JOIN geo USING (graph_id)"""))
def g28(spark, d):
    s = mesh.geometry_summary(*_surf(spark, d))
    return s.select(G, "n_nodes", *[r4(c).alias(c) for c in ("mean_fib", "share_half", "area", "mean_edge", "p90_fib")])


@query("g28_cohort_spread", k.q(S, GEOM, body=f"""
SELECT CASE WHEN graph_id = 'p0' THEN 'first' ELSE 'rest' END AS cohort, {k.r4('avg(area)')} AS area_mean, {k.r4('stddev_pop(area)')} AS area_sd, {k.r4('min(area)')} AS area_min, {k.r4('max(area)')} AS area_max FROM geo GROUP BY ALL"""))
def g28b(spark, d):
    s = mesh.geometry_summary(*_surf(spark, d))
    out = mesh.cohort_spread(s, F.when(F.col(G) == "p0", "first").otherwise("rest"), ["area"])
    return out.select("cohort", *[r4(c).alias(c) for c in out.columns if c != "cohort"])


EULER = """
chi AS (SELECT f.graph_id, (SELECT count(DISTINCT node_id) FROM corners c WHERE c.graph_id = f.graph_id {w}) - (SELECT count(*) FROM (SELECT DISTINCT src, dst, graph_id FROM face_edges c WHERE true {w}) e WHERE e.graph_id = f.graph_id)
  + (SELECT count(*) FROM faces c WHERE c.graph_id = f.graph_id {w}) AS chi FROM (SELECT DISTINCT graph_id FROM faces) f)"""


@query("g29_euler", k.q(S, EULER.format(w=""), EULER.replace("chi AS (", "chi2 AS (", 1).format(w="AND c.tag <> 3"), body="""
SELECT graph_id, a.chi AS chi_before, b.chi AS chi_after, a.chi - b.chi AS delta_chi FROM chi a JOIN chi2 b USING (graph_id)"""))
def g29(spark, d):
    return mesh.euler_census(cut(_surf(spark, d)[1]), 3)


ADJ = """
adj AS MATERIALIZED (SELECT graph_id, min(face_id) AS f1, max(face_id) AS f2, arg_min(tag, face_id) AS t1, arg_max(tag, face_id) AS t2 FROM face_edges GROUP BY graph_id, src, dst HAVING count(*) = 2)"""


@query("g30_face_adjacency", k.q(S, ADJ, body="SELECT graph_id, f1, f2, t1, t2 FROM adj"))
def g30(spark, d):
    return mesh.face_adjacency(_surf(spark, d)[1])


@query("g31_contact_fraction", k.q(S, ADJ, body=f"""
SELECT graph_id, count(*) FILTER ((t1 = 1 AND t2 = 2) OR (t1 = 2 AND t2 = 1)) AS touching, count(*) FILTER (t1 = 1 OR t2 = 1) AS incident,
  {k.r4('count(*) FILTER ((t1 = 1 AND t2 = 2) OR (t1 = 2 AND t2 = 1)) / greatest(count(*) FILTER (t1 = 1 OR t2 = 1), 1)', 6)} AS contact FROM adj GROUP BY ALL"""))
def g31(spark, d):
    return mesh.contact_fraction(_surf(spark, d)[1], 1, 2).withColumn("contact", r4("contact", 6))


@query("g32_tag_components", k.q(S, ADJ, """
own AS (SELECT graph_id, face_id AS node_id FROM faces WHERE tag = 1),
le AS (SELECT graph_id, f1 AS src, f2 AS dst FROM adj WHERE t1 = 1 AND t2 = 1)""", reach("le", "own"), """
sz AS (SELECT graph_id, comp, count(*) AS c FROM comp GROUP BY ALL)""", body="""
SELECT graph_id, count(*) FILTER (c >= 0.01 * t) AS n_large, count(*) AS n_comp FROM (SELECT *, sum(c) OVER (PARTITION BY graph_id) AS t FROM sz) GROUP BY graph_id""", recursive=True))
def g32(spark, d):
    """Same-tag pieces of tag 1; edges shared by two tag-1 faces only (a third face never occurs on the lattice)."""
    return mesh.tag_components(cut(_surf(spark, d)[1]), 1)


@query("g33_cotangent", k.q(S, """
fa AS MATERIALIZED (SELECT *, greatest(sqrt(nx*nx+ny*ny+nz*nz) / 2, 1e-12) AS area FROM fpts),
half AS (SELECT graph_id, least(a,b) AS src, greatest(a,b) AS dst, ((ax-cx)*(bx-cx)+(ay-cy)*(by_-cy)+(az-cz)*(bz-cz)) / (2*area) / 2 AS h FROM fa
  UNION ALL SELECT graph_id, least(b,c), greatest(b,c), ((bx-ax)*(cx-ax)+(by_-ay)*(cy-ay)+(bz-az)*(cz-az)) / (2*area) / 2 FROM fa
  UNION ALL SELECT graph_id, least(a,c), greatest(a,c), ((ax-bx)*(cx-bx)+(ay-by_)*(cy-by_)+(az-bz)*(cz-bz)) / (2*area) / 2 FROM fa),
cot AS (SELECT graph_id, src, dst, greatest(sum(h), 1e-4) AS cot FROM half GROUP BY ALL)""", body=f"SELECT graph_id, src, dst, {k.r4('cot * w')} AS w FROM cot JOIN edges USING (graph_id, src, dst)"))
def g33(spark, d):
    return mesh.cotangent(*_surf(spark, d))[0].withColumn("w", r4("w"))


@query("g33_lumped_mass", k.q(S, """
fa AS (SELECT graph_id, a, b, c, greatest(sqrt(nx*nx+ny*ny+nz*nz) / 2, 1e-12) / 3 AS m FROM fpts),
ms AS (SELECT graph_id, node_id, sum(m) AS m FROM (SELECT graph_id, a AS node_id, m FROM fa UNION ALL SELECT graph_id, b, m FROM fa UNION ALL SELECT graph_id, c, m FROM fa) GROUP BY ALL)""",
    body=f"SELECT graph_id, node_id, {k.r4('greatest(coalesce(m, 0), 1e-9)', 6)} AS mass FROM nodes LEFT JOIN ms USING (graph_id, node_id)"))
def g33m(spark, d):
    return mesh.cotangent(*_surf(spark, d))[1].withColumn("mass", r4("mass", 6))


@query("g34_threshold_subgraph", k.q(SURF, """
he AS (SELECT e.graph_id, src, dst FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE a.fibrosis <= 0.6 AND b.fibrosis <= 0.6)""",
    reach("he", "nodes"), """
best AS (SELECT graph_id, arg_max(comp, (c, -comp)) AS comp FROM (SELECT graph_id, comp, count(*) AS c FROM comp GROUP BY ALL) GROUP BY graph_id),
kept AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS nid FROM comp SEMI JOIN best USING (graph_id, comp))""",
    body="SELECT h.graph_id, a.nid AS src, b.nid AS dst, 1.0::DOUBLE AS w FROM he h JOIN kept a ON a.graph_id = h.graph_id AND a.node_id = src JOIN kept b ON b.graph_id = h.graph_id AND b.node_id = dst", recursive=True))
def g34(spark, d):
    nodes, faces = _surf(spark, d)
    return cc.threshold_subgraph(mesh.mesh_edges(faces), nodes, 0.6)[1]


@query("g35_site_mask", k.q(S, """
si AS (SELECT graph_id, x, y, z FROM nodes WHERE node_id IN (0, 137)),
h AS (SELECT n.graph_id, n.node_id, bool_or((n.x-s.x)**2 + (n.y-s.y)**2 + (n.z-s.z)**2 <= 0.04) AS hit FROM nodes n JOIN si s USING (graph_id) GROUP BY ALL)""", body="SELECT graph_id, node_id, hit FROM h"))
def g35(spark, d):
    n = _surf(spark, d)[0]
    sites = n.where("node_id in (0, 137)").select(G, F.col("node_id").alias("site"), "node_id")
    return mesh.site_mask(n, sites, 0.2).select(G, "node_id", "hit")


@query("g36_default_fields", k.q(S, body="""
SELECT graph_id, node_id, 0.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, 1.0::DOUBLE AS fz, round(coalesce(CASE WHEN fibrosis > 0.5 THEN fibrosis END, 0), 6) + 0.0::DOUBLE AS fibrosis, 0::BIGINT AS region FROM nodes"""))
def g36(spark, d):
    bare = _surf(spark, d)[0].select(G, "node_id", "x", "y", "z", F.when(F.col("fibrosis") > 0.5, F.col("fibrosis")).alias("fibrosis"))
    return mesh.default_fields(bare).select(G, "node_id", "fx", "fy", "fz", r4("fibrosis", 6).alias("fibrosis"), "region")


@query("g39_sample_nodes", k.q(k.POINTS, body=f"""
SELECT graph_id, node_id, pos FROM (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY {k.uniform(9, 'graph_id', 'node_id')}, node_id) - 1 AS pos FROM nodes) WHERE pos < 7"""))
def g39(spark, d):
    return mesh.sample_nodes(views.points(spark, d), 7, 9)
