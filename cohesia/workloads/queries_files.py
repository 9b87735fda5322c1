"""Sources and sinks: files are written by Spark from the given tables, then scanned back."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import r4
from ..plans.lineage import cut, scratch_path
from ..sources import surfaces as sf
from ..sources import tables as tb
from . import sqlkit as k
from . import views
from .queries_mesh import grid_sql
from .registry import query

G = "graph_id"
S = k.SURFACE


def vtk_ascii_lines(nodes, faces):
    """Ordered lines of one ASCII polydata file per patch: coordinates in microns, chart, intensity and a cell vector."""
    big = 10_000_000_000
    nn = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    nf = faces.groupBy(G).agg(F.count(F.lit(1)).alias("m"))
    size = nn.join(nf, G)
    t = lambda c: F.col(c).cast("string")
    heads = size.select(G, F.explode(F.array(
        *[F.struct(F.lit(o).cast("long").alias("ord"), c.alias("line")) for o, c in (
            (0, F.lit("# vtk DataFile Version 3.0")), (1, F.lit("patch")), (2, F.lit("ASCII")), (3, F.lit("DATASET POLYDATA")), (4, F.format_string("POINTS %d float", "n")),
            (big, F.format_string("POLYGONS %d %d", F.col("m"), F.col("m") * 4)), (2 * big, F.format_string("POINT_DATA %d", "n")), (2 * big + 1, F.lit("SCALARS UAC1 float 1")), (2 * big + 2, F.lit("LOOKUP_TABLE default")),
            (3 * big, F.lit("SCALARS UAC2 float 1")), (3 * big + 1, F.lit("LOOKUP_TABLE default")), (4 * big, F.lit("SCALARS IIR float 1")), (4 * big + 1, F.lit("LOOKUP_TABLE default")),
            (5 * big, F.format_string("CELL_DATA %d", "m")), (5 * big + 1, F.lit("VECTORS fiber_endo float")))]
    )).alias("h")).select(G, "h.ord", "h.line")
    body = nodes.select(G, (F.col("node_id") + 10).alias("ord"), F.concat_ws(" ", *[(F.col(c) * 1000).cast("string") for c in "xyz"]).alias("line"))
    rank = F.col("face_id")
    body = body.union(faces.select(G, rank + big + 10, F.concat_ws(" ", F.lit("3"), t("a"), t("b"), t("c"))))
    for i, c in ((2, "u"), (3, "v"), (4, "intensity")):
        body = body.union(nodes.select(G, F.col("node_id") + i * big + 10, t(c)))
    body = body.union(faces.select(G, rank + 5 * big + 10, F.concat_ws(" ", t("vx"), t("vy"), t("vz"))))
    return heads.union(body)


def _ascii(spark, d):
    nodes, faces = views.surface(spark, d)
    path = scratch_path(spark, "vtk")
    sf.write_ordered(vtk_ascii_lines(nodes, faces), path)
    return sf.read_vtk_ascii(spark, path, F.regexp_extract("_path", r"graph_id=([^/]+)/", 1))


FACE_NO = "fo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY face_id) - 1 AS cell_id FROM faces)"


@query("s01_vtk_ascii", k.q(S, FACE_NO, body=f"""
SELECT n.graph_id, 'point' AS kind, n.node_id AS id, {k.r4('x * 1000', 6)} AS p, {k.r4('y * 1000', 6)} AS q, {k.r4('z * 1000', 6)} AS r FROM nodes n
UNION ALL SELECT graph_id, 'face', cell_id, a::DOUBLE, b::DOUBLE, c::DOUBLE FROM fo
UNION ALL SELECT graph_id, 'scalar', node_id, {k.r4('u', 6)}, {k.r4('v', 6)}, {k.r4('intensity', 6)} FROM nodes
UNION ALL SELECT graph_id, 'vector', cell_id, {k.r4('vx', 6)}, {k.r4('vy', 6)}, {k.r4('vz', 6)} FROM fo"""))
def s01(spark, d):
    nodes, faces, scal, vec = _ascii(spark, d)
    wide = scal.groupBy(G, "node_id").pivot("name", ["UAC1", "UAC2", "IIR"]).agg(F.first("value"))
    six = lambda *cs: [r4(c, 6) for c in cs]
    out = nodes.select(G, F.lit("point").alias("kind"), F.col("node_id").alias("id"), *[c.alias(n) for c, n in zip(six("x", "y", "z"), "pqr")])
    out = out.union(faces.select(G, F.lit("face"), "cell_id", *[F.col(c).cast("double") for c in "abc"]))
    out = out.union(wide.select(G, F.lit("scalar"), "node_id", *six("UAC1", "UAC2", "IIR")))
    return out.union(vec.select(G, F.lit("vector"), "cell_id", *six("vx", "vy", "vz")))


def encode_grid(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bytes of one binary grid; a patch has at most 250 vertices."""
    n, f = pdf[pdf["kind"] == 0].sort_values("id"), pdf[pdf["kind"] == 1].sort_values("id")
    cells = np.column_stack([np.full(len(f), 3), f[["p", "q", "r"]].to_numpy()]).astype(">i4")
    parts = [
        b"# vtk DataFile Version 3.0\npatch\nBINARY\nDATASET UNSTRUCTURED_GRID\n", f"POINTS {len(n)} float\n".encode(), n[["p", "q", "r"]].to_numpy().astype(">f4").tobytes(),
        f"\nCELLS {len(f)} {4 * len(f)}\n".encode(), cells.tobytes(), f"\nCELL_TYPES {len(f)}\n".encode(), np.full(len(f), 5).astype(">i4").tobytes(),
        f"\nCELL_DATA {len(f)}\nSCALARS elemTag int 1\nLOOKUP_TABLE default\n".encode(), f["tag"].to_numpy().astype(">i4").tobytes(), b"\nVECTORS fiber float\n", f[["vx", "vy", "vz"]].to_numpy().astype(">f4").tobytes(), b"\n",
    ]
    return pd.DataFrame({"path": [f"{pdf[G].iloc[0]}.vtk"], "content": [b"".join(parts)]})


def _binary(spark, d):
    nodes, faces = views.surface(spark, d)
    zero = [F.lit(0.0)] * 3
    rows = nodes.select(G, F.lit(0).alias("kind"), F.col("node_id").alias("id"), *[(F.col(c) * 1000).alias(n) for c, n in zip("xyz", "pqr")], F.lit(0).alias("tag"), *[c.alias(n) for c, n in zip(zero, ("vx", "vy", "vz"))])
    rows = rows.union(faces.select(G, F.lit(1), "face_id", *[F.col(c).cast("double") for c in "abc"], "tag", "vx", "vy", "vz"))
    return rows.groupBy(G).applyInPandas(encode_grid, "path string, content binary")


@query("s02_vtk_binary", k.q(S, FACE_NO, body=f"""
SELECT graph_id, cell_id AS face_id, a, b, c, tag, {k.r4('vx::FLOAT', 5)} AS vx, {k.r4('vy::FLOAT', 5)} AS vy, {k.r4('vz::FLOAT', 5)} AS vz FROM fo"""))
def s02(spark, d):
    _, faces = sf.parse_vtk_binary(_binary(spark, d))
    return faces.select(G, "face_id", "a", "b", "c", "tag", *[r4(c, 5).alias(c) for c in ("vx", "vy", "vz")])


def _carp(spark, d):
    nodes, faces = views.surface(spark, d)
    path = scratch_path(spark, "carp")
    sf.write_carp(nodes, faces, path)
    return path


@query("s03_read_carp", k.q(S, FACE_NO, body="SELECT f.graph_id, cell_id AS face_id, a, b, c, CAST(n.region AS INTEGER) AS tag FROM fo f JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.a"))
def s03(spark, d):
    return sf.read_carp(spark, _carp(spark, d))[1]


@query("s04_write_carp", k.q(S, FACE_NO, """
m AS (SELECT f.graph_id, cell_id, (p.fx+q.fx+r.fx)/3 AS x, (p.fy+q.fy+r.fy)/3 AS y, (p.fz+q.fz+r.fz)/3 AS z FROM fo f JOIN nodes p ON p.graph_id = f.graph_id AND p.node_id = a
  JOIN nodes q ON q.graph_id = f.graph_id AND q.node_id = b JOIN nodes r ON r.graph_id = f.graph_id AND r.node_id = c)""", body=f"""
SELECT graph_id, cell_id AS face_id, {k.r4('x / sqrt(x*x+y*y+z*z)', 5)} AS fx, {k.r4('y / sqrt(x*x+y*y+z*z)', 5)} AS fy, {k.r4('z / sqrt(x*x+y*y+z*z)', 5)} AS fz FROM m"""))
def s04(spark, d):
    """The exported fibre file, read back."""
    f = sf.read_carp_fibres(spark, _carp(spark, d))
    return f.select(G, "face_id", *[r4(c, 5).alias(c) for c in ("fx", "fy", "fz")])


def encode_traces(batches):
    """Trace files (path, content) of rows (stem, v): a row holds one node's hourly series, bounded by the hours covered."""
    for b in batches:
        stems, series = b.column(0).to_pylist(), b.column(1)
        sizes = series.value_lengths().to_numpy(zero_copy_only=False)
        parts = np.split(series.flatten().to_numpy(zero_copy_only=False).astype("<f4"), np.cumsum(sizes)[:-1])
        head = {n: f"x:1 y:1 z:1 t:{n} type:float".encode().ljust(1024) for n in set(sizes.tolist())}
        content = [head[n] + v.tobytes() for n, v in zip(sizes.tolist(), parts)]
        yield pa.record_batch([pa.array([f"{s}.igb" for s in stems], pa.string()), pa.array(content, pa.binary())], names=["path", "content"])


@query("s05_igb", k.q(k.TRACES, body=f"SELECT run_id || '-' || node_id AS run_id, row_number() OVER (PARTITION BY run_id, node_id ORDER BY frame) - 1 AS frame, {k.r4('v', 2)} AS v FROM traces"))
def s05(spark, d):
    series = F.array_sort(F.collect_list(F.struct("frame", "v")))
    rows = views.traces(spark, d).groupBy("run_id", "node_id").agg(series.alias("s"))
    rows = rows.select(F.concat_ws("-", "run_id", F.col("node_id").cast("string")).alias("stem"), F.transform("s", lambda s: s["v"]).alias("v"))
    files = rows.mapInArrow(encode_traces, "path string, content binary")
    return sf.parse_igb(files).select("run_id", "frame", r4("v", 2).alias("v"))


@query("s06_outcomes", k.q(body="""
SELECT 'ID' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS subject, CASE c_custkey % 3 WHEN 0 THEN 'NR' WHEN 1 THEN 'AF' ELSE 'AFL' END AS outcome FROM customer""").replace("WITH \n", ""))
def s06(spark, d):
    c = views.table(spark, d, "customer")
    kk = F.col("c_custkey") % 3
    rows = c.select(F.concat(F.lit("ID"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("Patient_ID"), F.when(kk == 0, " nr").when(kk == 1, "Af ").otherwise("afl").alias("Recurrence_Rhythm_2yr"))
    path = scratch_path(spark, "outcomes")
    rows.write.option("header", True).csv(path)
    return tb.read_outcomes(spark, path)


@query("s07_subject_id", "SELECT c_custkey, CAST(c_custkey AS INTEGER) AS id FROM customer")
def s07(spark, d):
    c = views.table(spark, d, "customer")
    return c.select("c_custkey", tb.subject_id(F.concat(F.lit("Mesh_ID"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(".vtk"))).alias("id"))


@query("s08_require_rows", "SELECT count(*) AS n FROM documents")
def s08(spark, d):
    return tb.require_rows(views.table(spark, d, "documents"), "documents").agg(F.count(F.lit(1)).alias("n"))


_LISTED = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("s09_list_inputs", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _LISTED))
def s09(spark, d):
    """The listed tables, each a file or a folder of files, with the rows that a scan of it finds."""
    named = F.regexp_extract("path", r"([^/]+)\.parquet(/[^/]*)?$", 1)
    listed = tb.list_inputs(spark, d, pattern="*.parquet", nested=True).select(named.alias("name")).distinct()
    counts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _LISTED]
    return listed.join(reduce(DataFrame.union, counts), "name")


def _per_customer(todo):
    return todo.groupBy("subject").agg(F.count(F.lit(1)).alias("cnt"))


@query("s10_with_cache", "SELECT o_custkey AS subject, count(*) AS cnt FROM orders GROUP BY o_custkey")
def s10(spark, d):
    """First the even customers, then everybody: the second call only computes the odd ones."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"))
    root = scratch_path(spark, "cache")
    tb.with_cache(o.where("subject % 2 = 0"), root, {"mu": 0.36}, _per_customer)
    return tb.with_cache(o, root, {"mu": 0.36}, _per_customer).select("subject", "cnt")


@query("s11_build_sharded", "SELECT CAST(o_orderkey // 5000 AS INTEGER) AS shard, count(*) AS cnt, round(sum(o_totalprice), 2) + 0.0::DOUBLE AS total FROM orders GROUP BY ALL")
def s11(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = scratch_path(spark, "shards")
    agg = lambda t: t.groupBy("shard").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    tb.build_sharded(o.where("o_orderkey < 5000"), "o_orderkey", 5000, agg, out)
    return tb.build_sharded(o, "o_orderkey", 5000, agg, out).select("shard", "cnt", "total")


@query("s12_write_metrics", k.q(k.VERDICTS, body=f"SELECT cohort, tier, CASE WHEN sum(y) = 0 THEN NULL ELSE {k.r4('count(*) / sum(y)::DOUBLE')} END AS per_event FROM verdicts GROUP BY ALL"))
def s12(spark, d):
    v = views.verdicts(spark, d).groupBy("cohort", "tier").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    v = v.select("cohort", "tier", F.when(F.col("s") == 0, F.lit(float("inf"))).otherwise(r4(F.col("n") / F.nullif(F.col("s"), F.lit(0)))).alias("per_event"))
    path = scratch_path(spark, "metrics")
    tb.write_metrics(v, path)
    return spark.read.schema("cohort string, tier long, per_event double").json(path)


@query("s13_relabel", "SELECT doc_id, n_chars, CAST(toxic AS INTEGER) AS y FROM documents JOIN labels USING (doc_id)")
def s13(spark, d):
    lab = cut(views.table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("y")))
    rec = views.table(spark, d, "documents").join(lab.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars", F.lit(0).alias("y"))
    return tb.relabel(rec, lab, "doc_id")


@query("s14_reconcile", "SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def s14(spark, d):
    return tb.reconcile(views.table(spark, d, "documents").select("doc_id"), views.table(spark, d, "labels").select("doc_id"), "doc_id")


@query("s15_union_cohorts", """
SELECT cohort, count(*) AS n, round(avg(bal), 4) + 0.0::DOUBLE AS mean FROM (
  SELECT unnest([cohort, 'combined']) AS cohort, bal FROM (SELECT 'customer' AS cohort, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier)) GROUP BY cohort""")
def s15(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_acctbal").alias("bal"))
    s = views.table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"))
    u = tb.union_cohorts({"customer": c, "supplier": s})
    return u.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("bal")).alias("mean"))


VERT = """
cv AS (SELECT graph_id, node_id, avg(vx) AS mx, avg(vy) AS my, avg(vz) AS mz FROM corners GROUP BY ALL)"""


@query("g37_load_intensity_surface", k.q(S, VERT, body=f"""
SELECT n.graph_id, n.node_id, {k.r4('x', 6)} AS x, {k.r4('least(greatest((intensity - 1.0) / 0.32, 0), 1)', 5)} AS fibrosis, {grid_sql()} AS region,
  {k.r4('coalesce(mx / nullif(sqrt(mx*mx+my*my+mz*mz), 0), 1)', 5)} AS fx FROM nodes n LEFT JOIN cv ON cv.graph_id = n.graph_id AND cv.node_id = n.node_id"""))
def g37(spark, d):
    nodes, _ = sf.intensity_surface(_ascii(spark, d))
    return nodes.select(G, "node_id", r4("x", 6).alias("x"), r4("fibrosis", 5).alias("fibrosis"), "region", r4("fx", 5).alias("fx"))


@query("g38_load_tagged_surface", k.q(S, """
kept AS MATERIALIZED (SELECT * FROM corners WHERE tag <> 2),
rid AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS nid FROM (SELECT DISTINCT graph_id, node_id FROM kept)),
fv AS (SELECT graph_id, node_id, avg(CASE tag WHEN 1 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS fib FROM kept GROUP BY ALL)""", body=f"""
SELECT graph_id, nid AS node_id, {k.r4('x', 4)} AS x, {k.r4('fib', 6)} AS fibrosis FROM rid JOIN nodes USING (graph_id, node_id) JOIN fv USING (graph_id, node_id)"""))
def g38(spark, d):
    nodes, faces = sf.parse_vtk_binary(_binary(spark, d))
    nodes, _, _ = sf.tagged_surface(nodes, faces, drop=(2,), tag_values={1: 1.0, 3: 0.5}, dead=(2,))
    return nodes.select(G, "node_id", r4("x", 4).alias("x"), r4("fibrosis", 6).alias("fibrosis"))
