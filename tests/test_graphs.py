"""Closed forms, brute force and the distributed branch of every size-dependent operator."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohesia.operators import components as cc
from cohesia.operators import connectivity as cn
from cohesia.operators import fragility as fr
from cohesia.operators import mesh, paths, spatial
from cohesia.operators import spectrum as sp

G = "graph_id"


def random_cohort(seed=0, sizes=(12, 24, 40), extra=2.5):
    """Spanning path plus chords per graph; returns edge and node frames (pandas)."""
    r = np.random.default_rng(seed)
    e, n = [], []
    for g, size in enumerate(sizes):
        w = {(i, i + 1): r.uniform(0.3, 1.7) for i in range(size - 1)}
        while len(w) < size * extra:
            a, b = sorted(r.integers(0, size, 2))
            if a != b:
                w[(int(a), int(b))] = r.uniform(0.3, 1.7)
        e += [(f"g{g}", a, b, x) for (a, b), x in w.items()]
        xyz = r.uniform(0, 1, (size, 3))
        n += [(f"g{g}", i, *xyz[i], r.uniform(0, 1), int(i % 3)) for i in range(size)]
    return (
        pd.DataFrame(e, columns=[G, "src", "dst", "w"]),
        pd.DataFrame(n, columns=[G, "node_id", "x", "y", "z", "fibrosis", "region"]),
    )


def dense(e, n, g):
    k = int((n[G] == g).sum())
    m = np.zeros((k, k))
    for _, r in e[e[G] == g].iterrows():
        m[int(r.src), int(r.dst)] -= r.w
        m[int(r.dst), int(r.src)] -= r.w
    return m - np.diag(m.sum(axis=1))


@pytest.fixture(scope="module")
def cohort(spark):
    e, n = random_cohort()
    return e, n, spark.createDataFrame(e).cache(), spark.createDataFrame(n).cache()


def test_large_component_tasks_stay_small(spark):
    """A shuffle of ids that compress well is not merged into a few large tasks."""
    n = 2_000_000
    edges = spark.range(0, n, 1, 8).select(F.lit("g").alias(G), F.xxhash64("id").alias("src"), F.xxhash64(F.col("id") + n).alias("dst"))
    assert edges.groupBy(G, "src", "dst").count().select(F.spark_partition_id().alias("p")).distinct().count() >= 10


def test_components_of_large_and_small_graphs_together(spark):
    rows = [("big", i, i + 1) for i in range(0, 60, 2)] + [("big", i, i + 10) for i in range(0, 40, 10)] + [("small", 4, 2), ("small", 2, 7)]
    edges = spark.createDataFrame(rows, "graph_id string, src long, dst long")
    nodes = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).union(spark.createDataFrame([("bare", 5)], "graph_id string, node_id long")).distinct()
    a, b = (cc.components(edges, nodes, local_edges=k).orderBy(G, "node_id").toPandas() for k in (10, 1000))
    assert a.equals(b) and len(a) == nodes.count()


def test_large_graphs_that_settle_in_different_cycles(spark):
    rows = [("path", i, i + 1, 1.0) for i in range(150)] + [("star", 0, i, 1.0 + i / 100) for i in range(1, 70)]
    edges = spark.createDataFrame(rows, "graph_id string, src long, dst long, w double")
    nodes = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).distinct()
    v = sp.eigenvalues(sp.smallest_eigpairs(edges, nodes, 3)).orderBy(G, "idx").toPandas()
    assert list(v.n) == [151] * 3 + [70] * 3
    assert np.allclose(v[v[G] == "path"].val, [2 - 2 * math.cos(math.pi * k / 151) for k in range(3)], atol=1e-6)


def test_path_and_ring_spectra(spark):
    n = 40
    rows = [("path", i, i + 1, 1.0) for i in range(n - 1)] + [("ring", i, (i + 1) % n, 1.0) for i in range(n)]
    edges = spark.createDataFrame(rows, "graph_id string, src long, dst long, w double")
    nodes = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).distinct()
    v = sp.eigenvalues(sp.smallest_eigpairs(edges, nodes, 8)).toPandas()
    path = np.sort(v[v[G] == "path"].val)
    assert np.allclose(path, [2 - 2 * math.cos(math.pi * k / n) for k in range(8)], atol=1e-9)
    ring = np.sort(v[v[G] == "ring"].val)
    assert abs(ring[1] - ring[2]) < 1e-9


def test_filtered_iteration_matches_dense(spark, cohort):
    e, n, edges, nodes = cohort
    two = lambda df: df.where("graph_id <> 'g2'")
    pairs = sp.smallest_eigpairs(two(edges), two(nodes), 2, dense_limit=16, tol=1e-6).toPandas()  # g0 dense, g1 filtered
    for g in ("g0", "g1"):
        want = np.linalg.eigvalsh(dense(e, n, g))[:2]
        got = pairs[pairs[G] == g].groupby("idx").val.first().to_numpy()
        assert np.allclose(got, want, atol=1e-6)
        x = pairs[(pairs[G] == g) & (pairs.idx == 1)].sort_values("node_id").x.to_numpy()
        assert np.linalg.norm(dense(e, n, g) @ x - got[1] * x) < 1e-3
        assert abs(np.linalg.norm(x) - 1) < 1e-8


def test_lanczos_on_a_grid_with_double_values(spark):
    """A square grid above the dense bound: its second and third values are one double value."""
    a = 9
    rows = [("grid", i * a + j, i * a + j + s, 1.0) for i in range(a) for j in range(a) for s, ok in ((1, j + 1 < a), (a, i + 1 < a)) if ok]
    edges = spark.createDataFrame(rows, "graph_id string, src long, dst long, w double")
    nodes = spark.createDataFrame([("grid", i) for i in range(a * a)], "graph_id string, node_id long")
    assert a * a > sp.DENSE_LIMIT
    pairs = sp.smallest_eigpairs(edges, nodes, 3).toPandas()
    one = 2 - 2 * math.cos(math.pi / a)
    assert np.allclose(pairs.groupby("idx").val.first(), [0, one, one], atol=1e-9)
    x = np.stack([pairs[pairs.idx == i].sort_values("node_id").x.to_numpy() for i in range(3)])
    assert np.allclose(x @ x.T, np.eye(3), atol=1e-9) and (pairs.residual < 1e-5).all()


def test_large_graphs_are_dealt_by_column(spark, cohort, monkeypatch):
    """A graph above the bound of a task, with a hub whose column is split over salts, has the same pairs."""
    monkeypatch.setattr(sp, "TARGET_ROWS", 15)
    e = pd.DataFrame([("h", 0, i, 0.5 + i / 40) for i in range(1, 20)] + [("h", i, i + 1, 1.0) for i in range(1, 19)], columns=[G, "src", "dst", "w"])
    n = pd.DataFrame({G: "h", "node_id": range(20)})
    v = sp.eigenvalues(sp.smallest_eigpairs(spark.createDataFrame(e), spark.createDataFrame(n), 2, dense_limit=10)).toPandas().sort_values("idx")
    assert np.allclose(v.val, np.linalg.eigvalsh(dense(e, n, "h"))[:2], atol=1e-7)


@pytest.mark.parametrize("dense_limit", [60, 16])
def test_variants_match_dense(spark, dense_limit):
    """Values of changed graphs from the base pairs alone, and by the warm-started iteration above the bound."""
    from cohesia.operators import updates

    e, n = random_cohort(3, (12, 24))
    r = np.random.default_rng(1)
    drops = []
    for g in ("g0", "g1"):
        own = e[e[G] == g]
        for v, share in enumerate((0.3, 0.9)):
            drops += [(g, f"v{v}", int(x.src), int(x.dst), float(x.w * share)) for _, x in own.sample(3 + v, random_state=v).iterrows()]
        drops += [(g, "all", int(x.src), int(x.dst), float(x.w * 0.2 * r.random())) for _, x in own.iterrows()]
        drops += [(g, "more", 0, 7, -0.8), (g, "none", 0, 1, 0.0)]
    d = spark.createDataFrame(drops, "graph_id string, variant string, src long, dst long, drop double")
    got = updates.low_values(spark.createDataFrame(e), spark.createDataFrame(n), d, 2, dense_limit=dense_limit, subspace=4).toPandas()
    assert len(got) == 10 and (got.residual < 1e-5).all()
    for _, row in got.iterrows():
        m = dense(e, n, row[G])
        for g, v, a, b, x in drops:
            if (g, v) == (row[G], row.variant):
                m += x * (np.outer(np.eye(len(m))[a], np.eye(len(m))[b]) + np.outer(np.eye(len(m))[b], np.eye(len(m))[a]) - np.diag(np.eye(len(m))[a] + np.eye(len(m))[b]))
        assert np.allclose(np.linalg.eigvalsh(m)[:2], [row.l1, row.l2], atol=1e-7)


def test_laplacian_kinds(spark, cohort):
    e, n, edges, nodes = cohort
    bad = sp.laplacian(edges, nodes).groupBy(G, "i").agg(F.sum("val").alias("s")).where("abs(s) > 1e-9").count()
    assert bad == 0
    iso = nodes.union(spark.createDataFrame([("g0", 99, 0.0, 0.0, 0.0, 0.0, 0)], nodes.schema))
    assert sp.laplacian(edges, iso, "comb").where("i = 99").first()["val"] == 0.0
    assert sp.laplacian(edges, iso, "rw").where("i = 99").first()["val"] == 1.0
    with pytest.raises(ValueError):
        sp.laplacian(edges, nodes, "other")
    with pytest.raises(ValueError):
        sp.smallest_eigpairs(edges, nodes, 0)


def test_perron_on_bipartite_graph(spark):
    edges = spark.createDataFrame([("s", 0, i, 1.0) for i in range(1, 5)], "graph_id string, src long, dst long, w double")
    nodes = spark.createDataFrame([("s", i) for i in range(5)], "graph_id string, node_id long")
    p = sp.perron(edges, nodes).orderBy("node_id").toPandas()
    assert abs(p.rho[0] - 2.0) < 1e-9 and (p.perron >= 0).all()


@pytest.mark.parametrize("limit", [0, 20_000])
def test_components_both_branches(spark, limit):
    r = np.random.default_rng(3)
    e = pd.DataFrame({"graph_id": "g", "src": r.integers(0, 200, 120), "dst": r.integers(0, 200, 120)})
    nodes = spark.createDataFrame([("g", i) for i in range(200)], "graph_id string, node_id long")
    got = cc.components(spark.createDataFrame(e), nodes, local_edges=limit).toPandas().set_index("node_id").comp
    parent = list(range(200))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(e.src, e.dst):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(got[i] == find(i) for i in range(200))


@pytest.mark.parametrize("limit", [0, 20_000])
def test_shortest_paths_both_branches(spark, cohort, limit):
    e, n, edges, nodes = cohort
    src = spark.createDataFrame([("g0", 0), ("g1", 5), ("g2", 7)], "graph_id string, node_id long")
    got = paths.shortest_paths(edges.withColumnRenamed("w", "cost"), nodes, src, local_edges=limit).toPandas()
    for g, s in (("g0", 0), ("g1", 5), ("g2", 7)):
        k = int((n[G] == g).sum())
        d = np.full(k, np.inf)
        d[s] = 0
        for _ in range(k):
            for _, r in e[e[G] == g].iterrows():
                a, b = int(r.src), int(r.dst)
                d[b], d[a] = min(d[b], d[a] + r.w), min(d[a], d[b] + r.w)
        assert np.allclose(got[got[G] == g].sort_values("node_id").dist, d)


def test_unreachable_is_null(spark):
    c = spark.createDataFrame([("g", 0, 1, 1.0)], "graph_id string, src long, dst long, cost double")
    nodes = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2)], "graph_id string, node_id long")
    d = paths.shortest_paths(c, nodes, nodes.where("node_id = 0")).where("node_id = 2").first()
    assert d["dist"] is None


def test_fragility_is_the_derivative(spark, cohort):
    e, n, edges, nodes = cohort
    frag = fr.edge_fragility(edges, sp.fiedler(edges, nodes)).toPandas()
    for g in ("g0", "g1"):
        row = frag[frag[G] == g].iloc[3]
        h, lo = 1e-6, dense(e, n, g)
        s = np.zeros(len(lo))
        s[int(row.src)], s[int(row.dst)] = 1, -1
        up, dn = np.linalg.eigvalsh(lo + h * np.outer(s, s))[1], np.linalg.eigvalsh(lo - h * np.outer(s, s))[1]
        assert abs((up - dn) / (2 * h) - row.frag) < 1e-5


def test_fragility_vector(spark):
    phi = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 1.0), ("g", 2, -2.0), ("g", 3, 0.5)], "graph_id string, node_id long, phi double")
    e = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 0, 3, 1.0)], "graph_id string, src long, dst long, w double")
    got = fr.edge_fragility(e, phi).orderBy("src", "dst").toPandas().frag.tolist()
    assert sorted(got) == [0.25, 1.0, 9.0]


def test_degenerate_ring(spark):
    n = 8
    e = spark.createDataFrame([("r", min(i, (i + 1) % n), max(i, (i + 1) % n), 1.0) for i in range(n)], "graph_id string, src long, dst long, w double")
    nodes = spark.createDataFrame([("r", i, 0.1 + 0.4 * i / 7, 0) for i in range(n)], "graph_id string, node_id long, fibrosis double, region long")
    f = fr.perturbation_field(e, nodes)
    j = sp.lap_norm(f, nodes).join(sp.spectral_gap(e, nodes), G).select(fr.validity_ok(F.col("norm"), F.col("gap")).alias("ok")).first()
    assert j["ok"] is False
    s = fr.subspace_fragility(f, sp.smallest_eigpairs(e, nodes, 3)).agg(F.min("frag").alias("lo"), F.max("frag").alias("hi")).first()
    assert s["lo"] >= 0 and math.isfinite(s["hi"])


def test_monte_carlo_near_analytic(spark, cohort):
    _, _, edges, nodes = cohort
    mc = fr.sfi_monte_carlo(edges.where("graph_id = 'g1'"), nodes.where("graph_id = 'g1'"), 60, 5, mu=0.02, cov=0.4).where("region = '_all'").first()
    sfi = fr.sfi_edges(edges.where("graph_id = 'g1'"), nodes.where("graph_id = 'g1'"), sp.fiedler(edges, nodes), mu=0.02).agg(F.sum("sfi")).first()[0]
    assert abs(mc["mean"] - sfi) < 0.15 * sfi


@pytest.mark.parametrize("cov", [0.5, 0.6])
def test_reduction_draws_match_moments(spark, cov):
    f = spark.createDataFrame([("g", 0, 1, 10.0, 1.0, cov * cov)], "graph_id string, src long, dst long, w double, dw double, var double")
    s = fr.sample_dw(f, 4000, 3, cov).agg(F.avg("drop").alias("m"), F.stddev_samp("drop").alias("s"), F.min("drop").alias("lo")).first()
    assert abs(s["m"] - 1) < 0.04 and abs(s["s"] - cov) < 0.04 and s["lo"] >= 0


def test_min_cut(spark):
    rows = [("bar", 4 * s + a, 4 * s + b, 1.0) for s in (0, 1) for a in range(4) for b in range(a + 1, 4)] + [("bar", 0, 4, 0.01)]
    rows += [("line", i, i + 1, 1.0 + i) for i in range(5)] + [("long", i, i + 1, 1.0 + (i - 9) ** 2) for i in range(19)]
    e = spark.createDataFrame(rows, "graph_id string, src long, dst long, w double")
    nodes = e.select(G, F.col("src").alias("node_id")).union(e.select(G, "dst")).distinct().union(spark.createDataFrame([("two", 0), ("two", 1)], "graph_id string, node_id long"))
    got = {r[G]: r for r in cn.min_cut_bound(e, nodes).collect()}
    assert abs(got["bar"]["value"] - 0.01) < 1e-12 and got["bar"]["certified"]
    assert got["line"]["value"] == 1.0 and got["two"]["value"] == 0.0
    assert abs(got["long"]["value"] - 1.0) < 1e-9 and got["long"]["lower"] <= 1.0  # found by the sweep, above the exact size


def test_cut_edges(spark, cohort):
    _, _, edges, _ = cohort
    one = edges.where("graph_id = 'g0'").limit(1)
    out = mesh.cut_edges(edges, one)
    assert out.count() == edges.count() and out.where("w = 0").count() == 1
    with pytest.raises(ValueError):
        mesh.cut_edges(edges, spark.createDataFrame([("g0", 500, 501)], "graph_id string, src long, dst long"))


def test_tetrahedron(spark):
    f = spark.createDataFrame([("t", i, *v) for i, v in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])], "graph_id string, face_id long, a long, b long, c long")
    assert mesh.mesh_edges(f).count() == 6
    assert mesh.euler(f).first()["chi"] == 2
    assert mesh.face_adjacency(f.withColumn("tag", F.lit(1))).count() == 6
    with pytest.raises(ValueError):
        mesh.assert_tags(f.withColumn("tag", F.lit(7)), [7], [8])
    mesh.assert_tags(f.withColumn("tag", F.lit(7)), [7], [])


def test_knn_and_radius_against_brute_force(spark):
    r = np.random.default_rng(5)
    p = np.vstack([r.uniform(0, 1, (80, 2)), 0.5 + 1e-4 * r.uniform(0, 1, (60, 2)), [[9.0, 9.0]]])  # a third in one hot spot, one outlier
    nodes = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(p)], "graph_id string, node_id long, x double, y double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got = spatial.knn(nodes.withColumnRenamed("node_id", "qid"), nodes, 3, skip_self=True).toPandas()
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    assert len(got) == 3 * len(p)
    for q, part in got.groupby("qid"):
        assert np.allclose(np.sort(part.dist), want[q])
    pairs = spatial.radius_pairs(nodes, 0.1).select("src", "dst").toPandas()
    assert len(pairs) == int((np.triu(d <= 0.1, 1)).sum())
    lone = spark.createDataFrame([("h", i, float(i), 0.0) for i in range(8)], nodes.schema)
    assert spatial.radius_graph(lone, 0.5).count() >= 8  # falls back to nearest neighbours


def test_salted_bucket_join_is_exact(spark):
    from cohesia.plans.joins import salted

    a = spark.range(500).select((F.col("id") % 3 * 0).alias("k"), F.col("id").alias("l"))
    b = spark.range(7).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("r"))
    assert salted(a, b, ["k"], ["l"], target=50).distinct().count() == 3500


def test_coarsen(spark):
    from cohesia.workloads import views

    nodes, faces = views.surface(spark, "/root/testdata/sf0.001")
    n2, f2 = mesh.coarsen(nodes, faces, 60)
    a = n2.groupBy(G).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2) - 1)).alias("e")).collect()
    assert all(r["n"] <= 69 and r["e"] < 1e-9 for r in a)
    same, _ = mesh.coarsen(nodes, faces, 10_000)
    assert same.count() == nodes.count()


def test_coarse_regions_on_a_grid_line(spark):
    # Sums of ninths whose mean is 2/3 end one digit below it in some orders.
    place, below = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], math.nextafter(2 / 3, 0)
    rows = [("g", 3 * c + i, *p, 0.0, 0.0, 1.0, 0.5, below, below) for c, p in enumerate(place) for i in range(3)]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id long, x double, y double, z double, fx double, fy double, fz double, fibrosis double, u double, v double")
    nodes = nodes.withColumn("region", F.lit(0).cast("long"))
    faces = spark.createDataFrame([("g", 0, 0, 3, 6)], "graph_id string, face_id long, a long, b long, c long")
    coarse, _ = mesh.coarsen(nodes, faces, 3)
    assert [r["region"] for r in coarse.collect()] == [8, 8, 8]


@pytest.mark.parametrize("tile, queries, matrix", [(1, 7, 40), (2, 50, 500), (8, 20_000, 2_000_000)])
def test_knn_tiles(spark, monkeypatch, tile, queries, matrix):
    # Half of the points are copies, one lies far off: ties go by node id, whatever tile, salt or part of a matrix holds them.
    monkeypatch.setattr(spatial, "TILE", tile)
    monkeypatch.setattr(spatial, "TILE_QUERIES", queries)
    monkeypatch.setattr(spatial, "MATRIX", matrix)
    rng = np.random.default_rng(5)
    at = np.vstack([rng.normal(size=(60, 2)), np.repeat([[0.25, 0.5]], 40, 0), [[30.0, -20.0]]])
    p = pd.DataFrame({G: "g", "node_id": rng.permutation(len(at)), "x": at[:, 0], "y": at[:, 1]})
    nodes = spark.createDataFrame(p)
    got = spatial.knn(nodes.withColumnRenamed("node_id", "qid"), nodes, 4, skip_self=True)
    want = []
    for q in p.itertuples():
        d = np.sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2)
        near = sorted((a, int(n)) for a, n in zip(d, p.node_id) if n != q.node_id)[:4]
        want += [(int(q.node_id), i + 1, n, a) for i, (a, n) in enumerate(near)]
    assert sorted((r["qid"], r["rank"], r["node_id"], r["dist"]) for r in got.collect()) == sorted(want)


def test_long_centre_lists_take_the_join(spark, monkeypatch):
    r = np.random.default_rng(4)
    nodes = spark.createDataFrame([("g", i, *map(float, r.uniform(0, 1, 3))) for i in range(40)], "graph_id string, node_id long, x double, y double, z double").cache()
    c = nodes.where("node_id < 9").selectExpr("graph_id", "x cx", "y cy", "z cz", "0.7D amp")
    s = nodes.where("node_id in (3, 8)").selectExpr("graph_id", "node_id site", "node_id")
    run = lambda: (mesh.kernel_field(nodes, c, 0.3, sigma=0.2).orderBy("node_id").toPandas().field, mesh.site_mask(nodes, s, 0.4).orderBy("node_id").toPandas().hit)
    a = run()
    monkeypatch.setattr(mesh, "PACKED_ROWS", 0)
    b = run()
    assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all()


def test_carp_triple_side_by_side(spark, tmp_path):
    from cohesia.sources import surfaces

    (tmp_path / "m1.pts").write_text("3\n0 0 0\n1 0 0\n0 1 0\n\n")
    (tmp_path / "m1.elem").write_text("3\nLn 0 1 7\nTr 0 1 2 5\n\n")
    (tmp_path / "m1.lon").write_text("1 0 0\n")
    (tmp_path / "m2.pts").write_text("3\n0 0 0\n1 0 0\n0 1 0\nextra\n")
    (tmp_path / "m2.elem").write_text("1\nTr 0 2 1\nTr 9 9 9\n")
    (tmp_path / "m2.lon").write_text("1\n0 1 0\n")
    nodes, faces = surfaces.read_carp(spark, str(tmp_path))
    assert nodes.groupBy("graph_id").count().orderBy("graph_id").collect() == [("m1", 3), ("m2", 3)]
    assert [tuple(r) for r in faces.orderBy("graph_id").collect()] == [("m1", 0, 0, 1, 2, 5), ("m2", 0, 0, 2, 1, None)]
    fib = surfaces.read_carp_fibres(spark, str(tmp_path)).orderBy("graph_id").collect()
    assert [tuple(r) for r in fib] == [("m1", 0, 1.0, 0.0, 0.0), ("m2", 0, 0.0, 1.0, 0.0)]


def test_vtk_keywords_in_any_case(spark, tmp_path):
    from cohesia.sources import surfaces

    body = "# vtk DataFile Version 3.0\nx\nASCII\nDataset polydata\npoints 3 float\n0 0 0 1 0 0\n0 1 0\npolygons 1 4\n3 0 1 2\n"
    (tmp_path / "a.vtk").write_text(body)
    nodes, faces, _, _ = surfaces.read_vtk_ascii(spark, str(tmp_path / "a.vtk"))
    assert nodes.count() == 3 and faces.count() == 1
    (tmp_path / "b.vtk").write_text(body.replace("points", "pints"))
    with pytest.raises(ValueError):
        surfaces.read_vtk_ascii(spark, str(tmp_path / "b.vtk"))


def test_gate_chain_takes_the_best_classifier(spark):
    from cohesia.operators import models

    rows = [("a", .12, .01, .80, .01), ("a", .02, .60, .70, .02), ("b", .07, .01, .80, .01), ("c", .12, .01, .60, .01), ("d", .12, .01, .80, .05), ("e", .12, .01, .80, .06), ("f", .12, .20, .80, .01)]
    got = {r.k: r.verdict for r in models.gate_chain(spark.createDataFrame(rows, "k string, delta double, p double, baseline_auc double, p_noise double"), ["k"]).collect()}
    assert got == {"a": "met", "b": "inconclusive: underpowered", "c": "not met: degraded baseline", "d": "met", "e": "not met: noise explains", "f": "inconclusive: test does not reject"}


def test_traces_are_packed_by_the_batch():
    """Many short trace files become one batch of frames, a long one several; nothing is started for a single file."""
    from cohesia.sources import surfaces as sf
    from cohesia.workloads.queries_files import encode_traces

    series = [np.arange(i % 5 + 1) + 0.5 for i in range(1000)] + [np.arange(150_000.0)]
    rows = pa.record_batch([pa.array([f"run-{i}" for i in range(len(series))]), pa.array(series, pa.list_(pa.float64()))], names=["stem", "v"])
    out = list(sf._decode_traces(encode_traces([rows])))
    assert len(out) < 5
    got = pa.Table.from_batches(out).to_pandas()
    assert got["run_id"].tolist() == [f"run-{i}" for i, v in enumerate(series) for _ in v]
    assert got["frame"].tolist() == [f for v in series for f in range(len(v))]
    assert (got["v"] == np.concatenate(series)).all() and (got["node_id"] == 0).all()


@pytest.mark.parametrize("name", ["c01_components", "c01_components_joined"])
def test_retail_components_join_customers_by_their_lines(spark, tmp_path, name):
    """Customers without orders, orders without customers and lines of unknown orders are nodes as well; a shared pair links two orders."""
    import __spark_entry__ as entry
    from compare import connect, difference

    pd.DataFrame({"c_custkey": [1, 2, 3, 4, 5]}).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"o_custkey": pd.array([1, 2, 3, 3, None, 5], dtype="Int64"), "o_orderkey": [10, 20, 30, 31, 40, 1]}).to_parquet(tmp_path / "orders.parquet")
    li = pd.DataFrame({"l_orderkey": [10, 10, 20, 30, 31, 90, 91, 40], "l_partkey": [7, 8, 8, 9, 9, 6, 6, 5], "l_suppkey": [1, 1, 1, 1, 2, 3, 3, 3]})
    li.to_parquet(tmp_path / "lineitem.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    pair = lambda p, s: (1 << 62) + p * (1 << 31) + s
    want = {2: {2, 4, 21, 41, pair(7, 1), pair(8, 1)}, 6: {6, 61, 63, pair(9, 1), pair(9, 2)}, 8: {8}, 3: {3, 10}, 81: {81, pair(5, 3)}, 181: {181, 183, pair(6, 3)}}
    assert dict(zip(got.comp, got.members)) == {k: len(v) for k, v in want.items()} and all(min(v) == k for k, v in want.items())
    assert difference(got, connect(str(tmp_path)).execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("limit", [0, 30, 20_000])
def test_components_of_paths_stars_and_trees(spark, limit):
    """Ids that grow and fall along a path, hubs of small and large id, random trees and chords: rounds of every kind."""
    r = np.random.default_rng(11)
    links = [(i, i + 1) for i in range(100, 160)] + [(300 - i, 299 - i) for i in range(40)] + [(400, i) for i in range(401, 440)] + [(599, i) for i in range(560, 599)]
    mixed = r.permutation(np.arange(700, 800))
    links += [(int(mixed[i]), int(mixed[r.integers(0, i)])) for i in range(1, 100)] + [tuple(map(int, r.integers(1000, 1200, 2))) for _ in range(130)]
    parent = {i: i for link in links for i in link}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    edges = spark.createDataFrame([(g, a, b) for g in ("g", "h") for a, b in links], "graph_id string, src long, dst long")
    nodes = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).distinct()
    got = cc.components(edges, nodes, local_edges=limit).toPandas()
    assert len(got) == 2 * len(parent) and all(c == find(i) for i, c in zip(got.node_id, got.comp))
