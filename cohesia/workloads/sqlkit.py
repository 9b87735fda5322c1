"""DuckDB SQL fragments that define the same views, plus an eigen-projector built by matrix squaring."""

from __future__ import annotations

TRADE = """
lines AS MATERIALIZED (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS graph_id, CAST(c_nationkey AS BIGINT) AS cn, CAST(s_nationkey AS BIGINT) AS sn,
         l_extendedprice AS price, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
edges AS MATERIALIZED (
  SELECT graph_id, least(cn, sn) AS src, greatest(cn, sn) AS dst, sum(price) / 1e6 AS w FROM lines WHERE cn <> sn GROUP BY ALL),
fib AS (SELECT graph_id, sn AS node_id, avg(CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fibrosis FROM lines GROUP BY ALL),
ids AS (SELECT graph_id, src AS node_id FROM edges UNION SELECT graph_id, dst FROM edges),
nodes AS MATERIALIZED (
  SELECT i.graph_id, i.node_id, CAST(i.node_id % 5 AS DOUBLE) AS x, CAST(i.node_id // 5 AS DOUBLE) AS y, 0.0::DOUBLE AS z,
         coalesce(f.fibrosis, 0.0::DOUBLE) AS fibrosis, (i.node_id % 5) / 4.0::DOUBLE AS u, (i.node_id // 5) / 4.0::DOUBLE AS v,
         CAST(n_regionkey AS BIGINT) AS region
  FROM ids i JOIN nation ON n_nationkey = i.node_id LEFT JOIN fib f ON f.graph_id = i.graph_id AND f.node_id = i.node_id)"""

SPARSE = TRADE.replace("edges AS MATERIALIZED", "all_edges AS MATERIALIZED").replace("FROM edges", "FROM all_edges") + """,
med AS (SELECT graph_id, quantile_cont(w, 0.5) AS med FROM all_edges GROUP BY ALL),
edges AS MATERIALIZED (SELECT e.graph_id, src, dst, w FROM all_edges e JOIN med m ON e.graph_id = m.graph_id WHERE w >= med)"""

PARTS = """
edges AS MATERIALIZED (SELECT 'parts' AS graph_id, -1 - l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
nodes AS MATERIALIZED (SELECT graph_id, src AS node_id FROM edges UNION SELECT graph_id, dst FROM edges)"""

RETAIL = """
edges AS MATERIALIZED (
  SELECT 'retail' AS graph_id, o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst, 1.0::DOUBLE AS w FROM orders
  UNION ALL SELECT 'retail', l_orderkey * 2 + 1, 4611686018427387904 + l_partkey * 2147483648 + l_suppkey, 1.0::DOUBLE FROM lineitem),
nodes AS MATERIALIZED (
  SELECT graph_id, node_id FROM (SELECT 'retail' AS graph_id, c_custkey * 2 AS node_id FROM customer UNION SELECT graph_id, src FROM edges UNION SELECT graph_id, dst FROM edges)
  WHERE node_id IS NOT NULL)"""

_E = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 9))
_S = lambda i: f"(e{i} - min(e{i}) OVER ()) / (max(e{i}) OVER () - min(e{i}) OVER ())"

POINTS = f"""
emb AS (SELECT vec_id, label, {_E} FROM embeddings),
nodes AS MATERIALIZED (SELECT 'l' || label AS graph_id, vec_id AS node_id, {_S(1)} AS x, {_S(2)} AS y, {_S(3)} AS z,
         {_S(1)} AS u, {_S(2)} AS v, {_S(4)} AS fibrosis FROM emb)"""

SURFACE = f"""
emb AS (SELECT vec_id, CAST(label AS BIGINT) AS label, {_E} FROM embeddings),
nodes AS MATERIALIZED (SELECT 'p' || (vec_id // 250) AS graph_id, vec_id % 250 AS node_id, e1 AS x, e2 AS y, e3 AS z, e4 AS fx, e5 AS fy, e6 AS fz,
         least(greatest(0.5 + e7 * 2, 0.0), 1.0)::DOUBLE AS fibrosis, ((vec_id % 250) % 25) / 24.0::DOUBLE AS u,
         ((vec_id % 250) // 25) / 9.0::DOUBLE AS v, label AS region, label, 1.16 + e8 AS intensity FROM emb),
cells AS (SELECT * FROM (SELECT *, max(node_id) OVER (PARTITION BY graph_id) AS last FROM nodes) WHERE node_id % 25 < 24 AND node_id + 26 <= last),
faces AS MATERIALIZED (
  SELECT graph_id, node_id * 2 AS face_id, node_id AS a, node_id + 1 AS b, node_id + 25 AS c, CAST(label AS INTEGER) AS tag, fx AS vx, fy AS vy, fz AS vz FROM cells
  UNION ALL
  SELECT graph_id, node_id * 2 + 1, node_id + 1, node_id + 26, node_id + 25, CAST(label AS INTEGER), fx, fy, fz FROM cells),
corners AS MATERIALIZED (
  SELECT graph_id, face_id, tag, vx, vy, vz, a AS node_id FROM faces UNION ALL SELECT graph_id, face_id, tag, vx, vy, vz, b FROM faces
  UNION ALL SELECT graph_id, face_id, tag, vx, vy, vz, c FROM faces),
face_edges AS MATERIALIZED (
  SELECT graph_id, face_id, tag, least(p, q) AS src, greatest(p, q) AS dst FROM (
    SELECT graph_id, face_id, tag, a AS p, b AS q FROM faces UNION ALL SELECT graph_id, face_id, tag, b, c FROM faces
    UNION ALL SELECT graph_id, face_id, tag, a, c FROM faces)),
mesh_edges AS MATERIALIZED (SELECT DISTINCT graph_id, src, dst FROM face_edges),
ends AS MATERIALIZED (
  SELECT e.graph_id, e.src, e.dst, s.x AS xs, s.y AS ys, s.z AS zs, d.x AS xd, d.y AS yd, d.z AS zd,
         s.fx + d.fx AS gx, s.fy + d.fy AS gy, s.fz + d.fz AS gz, s.fibrosis AS fs, d.fibrosis AS fd,
         sqrt((d.x-s.x)**2 + (d.y-s.y)**2 + (d.z-s.z)**2) AS length
  FROM mesh_edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN nodes d ON d.graph_id = e.graph_id AND d.node_id = e.dst),
edges AS MATERIALIZED (
  SELECT graph_id, src, dst, length, (0.3 + 0.7 * CASE WHEN length > 0 AND gx*gx+gy*gy+gz*gz > 0 THEN
       ((xd-xs)*gx + (yd-ys)*gy + (zd-zs)*gz)**2 / (length**2 * (gx*gx+gy*gy+gz*gz)) ELSE 0 END)
       * least(greatest(1 - (fs + fd) / 2, 0.05), 1.0) AS w FROM ends),
fpts AS MATERIALIZED (
  SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz,
     (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) AS nx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) AS ny, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) AS nz
  FROM faces f JOIN nodes p ON p.graph_id = f.graph_id AND p.node_id = f.a JOIN nodes q ON q.graph_id = f.graph_id AND q.node_id = f.b
  JOIN nodes r ON r.graph_id = f.graph_id AND r.node_id = f.c)"""

SCORED = """
scored AS MATERIALIZED (
  SELECT d.doc_id, d.lang, d.source, CAST(1 - quality AS INTEGER) AS low, CAST(toxic AS INTEGER) AS toxic, CAST(n_chars AS DOUBLE) AS size,
         length(regexp_replace(d.text, '[^0-9]', '', 'g')) / length(d.text)::DOUBLE AS digit_share,
         (length(d.text) - length(replace(d.text, ' ', '')) + 1)::DOUBLE AS tokens,
         (length(d.text) - length(replace(d.text, ' ', '')) + 1) / length(d.text)::DOUBLE AS blank_share
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TRACES = """
traces AS MATERIALIZED (
  SELECT event_type AS run_id, user_id AS node_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame, max(value) AS v FROM events GROUP BY ALL)"""

PHASES = TRACES + """,
phases AS MATERIALIZED (SELECT run_id, node_id, frame, (v / max(v) OVER (PARTITION BY run_id) * 2 - 1) * 3.141592653589793::DOUBLE AS theta FROM traces)"""

VERDICTS = """
verdicts AS MATERIALIZED (
  SELECT o_custkey AS subject, CAST(year(o_orderdate) AS BIGINT) AS tier, any_value(c_mktsegment) AS cohort,
         max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS y, avg(o_totalprice) AS score, count(*) AS cnt, any_value(c_acctbal) AS cov
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY o_custkey, year(o_orderdate)")


def q(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes if c) + "\n" + body.strip()


def r4(expr: str, digits: int = 4) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE)"


def uniform(seed: int, *keys: str) -> str:
    text = f"'{seed}'" + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(seed: int, *keys: str) -> str:
    a, b = uniform(seed, *keys, "'a'"), uniform(seed, *keys, "'b'")
    return f"(sqrt(-2.0::DOUBLE * ln(1 - {a})) * cos(6.283185307179586::DOUBLE * {b}))"


def laplacian(edges: str = "edges", nodes: str = "nodes", name: str = "lap", w: str = "w", key: str = "graph_id") -> str:
    """COO Laplacian CTEs named `<name>` with columns (g, i, j, v)."""
    return f"""
{name}_adj AS MATERIALIZED (SELECT {key} AS g, src AS i, dst AS j, {w} AS w FROM {edges} WHERE src <> dst UNION ALL SELECT {key}, dst, src, {w} FROM {edges} WHERE src <> dst),
{name} AS MATERIALIZED (SELECT g, i, j, sum(v) AS v FROM (SELECT g, i, j, -w AS v FROM {name}_adj UNION ALL SELECT g, i, i, w FROM {name}_adj
  UNION ALL SELECT {key}, node_id, node_id, 0.0::DOUBLE FROM {nodes}) GROUP BY ALL)"""


def lowest(mat: str, k: int, name: str = "eig", squarings: int = 16) -> str:
    """CTEs `<name>1..k`(g, i, j, p): projectors on the k smallest eigenvectors; `<name>_val`(g, idx, val).

    cI - M with c above the Gershgorin bound is squared until only its leading direction is left,
    then deflated. Needs simple eigenvalues.
    """
    out = [f"""
{name}_c AS MATERIALIZED (SELECT g, max(b) + 0.001::DOUBLE * max(abs(b)) + 1e-9::DOUBLE AS c FROM (SELECT g, i, sum(abs(v)) AS b FROM {mat} GROUP BY ALL) GROUP BY g),
{name}_ids AS MATERIALIZED (SELECT DISTINCT g, i FROM {mat}),
{name}_r0 AS MATERIALIZED (SELECT a.g, a.i, b.i AS j, coalesce(-m.v, 0.0::DOUBLE) + CASE WHEN a.i = b.i THEN c ELSE 0.0::DOUBLE END AS v
  FROM {name}_ids a JOIN {name}_ids b ON a.g = b.g JOIN {name}_c s ON s.g = a.g LEFT JOIN {mat} m ON m.g = a.g AND m.i = a.i AND m.j = b.i)"""]
    for t in range(1, k + 1):
        cur = f"{name}_r{t - 1}"
        for s in range(squarings):
            nxt = f"{name}_s{t}_{s}"
            out.append(f"""
{nxt} AS MATERIALIZED (SELECT a.g, a.i, b.j, sum(a.v * b.v / (n.t * n.t)) AS v FROM {cur} a JOIN {cur} b ON a.g = b.g AND a.j = b.i
  JOIN (SELECT g, sum(v) AS t FROM {cur} WHERE i = j GROUP BY g) n ON n.g = a.g GROUP BY ALL)""")
            cur = nxt
        out.append(f"""
{name}{t} AS MATERIALIZED (SELECT a.g, i, j, v / t AS p FROM {cur} a JOIN (SELECT g, sum(v) AS t FROM {cur} WHERE i = j GROUP BY g) n ON n.g = a.g),
{name}_v{t} AS MATERIALIZED (SELECT p.g, {t - 1} AS idx, sum(p.p * m.v) AS val FROM {name}{t} p JOIN {mat} m ON m.g = p.g AND m.i = p.j AND m.j = p.i GROUP BY ALL)""")
        if t < k:
            out.append(f"""
{name}_r{t} AS MATERIALIZED (SELECT r.g, r.i, r.j, r.v - p.p * (c - e.val) AS v FROM {name}_r{t - 1} r JOIN {name}{t} p ON p.g = r.g AND p.i = r.i AND p.j = r.j
  JOIN {name}_c s ON s.g = r.g JOIN {name}_v{t} e ON e.g = r.g)""")
    out.append(f"""
{name}_val AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {name}_v{t}' for t in range(1, k + 1))})""")
    return ",".join(out)
