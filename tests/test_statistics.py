import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohesia.functions import rng
from cohesia.functions.tails import binom_ci, mcnemar, two_sided_p
from cohesia.plans.ordered import quantiles
from cohesia.operators import localise as lo
from cohesia.operators import models as md
from cohesia.operators import statistics as st
from cohesia.operators import traces as tr
from cohesia.plans import ordered
from cohesia.sources import surfaces as sf
from cohesia.sources import tables as tb


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 200)
    a = np.round(y + r.normal(0, 1.0, 200), 1)
    b = np.round(0.4 * y + r.normal(0, 1.0, 200), 1)
    pdf = pd.DataFrame({"id": np.arange(200), "y": y, "a": a, "b": b, "grp": [f"s{i % 12}" for i in range(200)]})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.fixture
def force_distributed(monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", -1)


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).mean() + 0.5 * (p[:, None] == n[None]).mean())


def brute_delong(y, a, b):
    def place(s):
        p, n = s[y == 1], s[y == 0]
        k = (p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])
        return k.mean(1), k.mean(0)

    (pa, na), (pb, nb) = place(a), place(b)
    return pa.mean() - pb.mean(), np.var(pa - pb, ddof=1) / len(pa) + np.var(na - nb, ddof=1) / len(na)


def test_auc_and_delong(spark, scored):
    pdf, df = scored
    y, a, b = (pdf[c].to_numpy() for c in ("y", "a", "b"))
    assert abs(st.auc(df, [], "y", "a").first()["auc"] - brute_auc(y, a)) < 1e-12
    r = st.delong(df, [], "y", "a", "b").first()
    d, v = brute_delong(y, a, b)
    assert abs(r["delta"] - d) < 1e-12 and abs(r["var"] - v) < 1e-12 and 0 <= r["p"] <= 1
    same = st.delong(df, [], "y", "a", "a").first()
    assert same["delta"] == 0 and same["p"] == 1.0
    one = st.auc(df.where("y = 1"), [], "y", "a").first()
    assert one["auc"] is None


def test_distributed_ranks_equal_windows(spark, scored, force_distributed):
    pdf, df = scored
    got = st.midrank(df, [], "a").toPandas().sort_values("id").midrank.to_numpy()
    assert np.allclose(got, pdf.a.rank().to_numpy())
    n = ordered.row_numbers(df, ["grp"], [F.col("a"), F.col("id")], "k").toPandas()
    want = pdf.sort_values(["a", "id"]).groupby("grp").cumcount()
    assert (n.set_index("id").k.sort_index() == want.sort_index()).all()
    q = ordered.quantiles(df, ["grp"], "a", {"m": 0.5, "p": 0.9}).toPandas().set_index("grp")
    for g, part in pdf.groupby("grp"):
        assert abs(q.m[g] - np.percentile(part.a, 50)) < 1e-9 and abs(q.p[g] - np.percentile(part.a, 90)) < 1e-9
    r = st.delong(df, [], "y", "a", "b").first()
    assert abs(r["delta"] - brute_delong(*(pdf[c].to_numpy() for c in ("y", "a", "b")))[0]) < 1e-12


def test_partition_invariance(spark, scored):
    _, df = scored
    out = []
    for n in (1, 8):
        out.append(st.auc_ci(df.repartition(n), "id", "y", "a", 60, 42).first())
    assert out[0] == out[1] and out[0]["lo"] <= out[0]["auc"] <= out[0]["hi"]


def test_tails(spark):
    rows = spark.createDataFrame([(float(z),) for z in (0.0, 0.5, 1.96, 4.0)], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(r["z"] / math.sqrt(2))) < 1e-6 for r in rows)
    m = spark.createDataFrame([(3, 9), (0, 0), (5, 5)], "b long, c long").select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in m:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert abs(r["p"] - want) < 1e-12
    c = spark.createDataFrame([(0, 10), (10, 10), (48, 82)], "k long, n long").withColumn("ci", binom_ci(F.col("k"), F.col("n"))).collect()
    assert c[0]["ci"]["lo"] == 0.0 and abs(c[0]["ci"]["hi"] - (1 - 0.025 ** 0.1)) < 1e-9 and c[1]["ci"]["hi"] == 1.0
    tail = sum(math.comb(82, i) * c[2]["ci"]["lo"] ** i * (1 - c[2]["ci"]["lo"]) ** (82 - i) for i in range(48, 83))
    assert abs(tail - 0.025) < 1e-9


def test_draws_are_uniform(spark):
    u = spark.range(20000).select(rng.uniform(3, "id").alias("u"), rng.normal(3, "id").alias("n")).agg(F.avg("u").alias("m"), F.stddev("u").alias("s"), F.avg("n").alias("nm"), F.stddev("n").alias("ns")).first()
    assert abs(u["m"] - 0.5) < 0.01 and abs(u["s"] - 12**-0.5) < 0.01 and abs(u["nm"]) < 0.03 and abs(u["ns"] - 1) < 0.03


def test_logistic_satisfies_optimality(spark, scored):
    pdf, df = scored
    m = md.fit_logistic(df.withColumn("k", F.lit(1)), ["k"], "y", ["a", "b"], 0.3).first()
    z = (pdf[["a", "b"]].to_numpy() - np.array(m["mean"])) / np.array(m["scale"])
    w, b = np.array(m["w"]), m["intercept"]
    mu = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.allclose(0.3 * z.T @ (mu - pdf.y) + w, 0, atol=1e-7) and abs(0.3 * (mu - pdf.y).sum() + b) < 1e-7


def test_folds_keep_groups_together(spark, scored):
    _, df = scored
    f = md.group_folds(df, "grp", 5)
    assert f.groupBy("grp").agg(F.countDistinct("fold").alias("c")).where("c > 1").count() == 0 and f.count() == 200
    s = md.shuffled_folds(df, "id", 5, 0).groupBy("fold").count().toPandas()
    assert set(s["count"]) == {40}


def test_leaky_design(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(24, 6))
    y = r.integers(0, 2, 24)
    rows = [(int(g * 4 + c), int(y[g]), int(g), *map(float, x[g] + 0.01 * r.normal(size=6))) for g in range(24) for c in range(4)]
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "id long, y int, family long, " + ", ".join(f"{c} double" for c in cols))
    t = md.grouped_vs_naive(df, "id", "y", cols, "family", 6).first()
    assert t["auc_grouped"] < t["auc_naive"]


def test_noise_and_single_class(spark, scored):
    _, df = scored
    rows = md.group_folds(df, "grp", 4)
    t = md.noise_control(rows, "id", "y", ["a"], 2, 0.5, draws=3).first()
    assert t["p_noise"] == 0.25
    one = md.oof_logistic(rows.withColumn("y", F.lit(1)), [], "y", ["a"]).agg(F.min("prob").alias("p")).first()
    assert one["p"] == 1.0


def test_linear_blocks(spark, scored):
    pdf, df = scored
    df = df.withColumn("c", F.col("a") * 2 - F.col("b") + 1)
    assert abs(md.r2(df, "c", ["a", "b"]).first()["r2"] - 1) < 1e-9
    assert abs(md.canon_corr(df, ["c", "id"], ["a", "b"]).first()["canon_corr"] - 1) < 1e-6
    with pytest.raises(ValueError):
        md.design_matrix(spark.createDataFrame([("s", "f", 1.0)], "graph_id string, name string, value double"), spark.createDataFrame([("t", 1)], "graph_id string, y int"))


def test_holm_and_2x2(spark):
    d = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "id long, p double")
    got = {r["id"]: round(r["holm"], 6) for r in st.holm(d, "p").collect()}
    assert got == {0: 0.03, 1: 0.06, 2: 0.06}
    ok = st.reconstruct_2x2(spark.createDataFrame([(10, 5, 3, 8)], "n long, n_a long, n_b long, n_agree long")).first()
    assert (ok["lost"], ok["gained"], ok["both"], ok["neither"]) == (2, 0, 3, 5)
    with pytest.raises(Exception):
        st.reconstruct_2x2(spark.createDataFrame([(10, 5, 4, 8)], "n long, n_a long, n_b long, n_agree long")).collect()


def test_torus_null(spark):
    r = np.random.default_rng(2)
    p = spark.createDataFrame([("g", i, *map(float, r.uniform(0, 1, 2)), float(i == 17)) for i in range(300)], "graph_id string, node_id long, u double, v double, score double")
    t = lo.colocalise(p, p, spark.createDataFrame([("g", 17)], "graph_id string, origin long"), 200, 0).first()
    assert t["observed"] == 0 and t["passed"] and 0 <= t["p"] <= 1


def test_trace_rules(spark):
    on = [1, 1, 0, 1, 1, 1, 0, 0, 0, 1]
    fr = spark.createDataFrame([("r", 0, i, float(v)) for i, v in enumerate(on)] + [("r", 1, i, 0.0) for i in range(10)], "run_id string, node_id long, frame long, v double")
    assert tr.sustained(fr, 0.5, -1, 2.0).first()["sustained"] == 6.0
    assert tr.sustained(fr, 0.5, 8, 1.0, min_window=5).first()["sustained"] is None
    assert tr.sustained_until_quiet(fr, 0.5, 0, 3, 1.0).first()["sustained"] == 6.0
    assert tr.upcrossings(fr, 0.5).where("node_id = 0").first()["crossings"] == 2


TINY = """# vtk DataFile Version 3.0
tiny
ASCII
DATASET POLYDATA
POINTS 4 float
0 0 0 1000 0 0
1000 1000 0
0 1000 0
POLYGONS 1 5
4 0 1 2 3
POINT_DATA 4
SCALARS UAC1 float 1
LOOKUP_TABLE default
0 0.5
1 1.5
SCALARS IIR float
1 1.16 1.32 1.5
CELL_DATA 1
VECTORS fiber_endo float
0 2 0
"""


def test_ascii_surface(spark, tmp_path):
    (tmp_path / "Mesh_ID007.vtk").write_text(TINY)
    nodes, faces = sf.load_intensity_surface(spark, str(tmp_path))
    n = nodes.orderBy("node_id").toPandas()
    assert np.allclose(n.fibrosis, [0, 0.5, 1, 1], atol=0.02) and np.allclose(n.x, [0, 1, 1, 0]) and np.allclose(n.u, [0, 0.5, 1, 1])
    assert np.allclose(n.fy, 1) and faces.count() == 2 and n.graph_id[0] == "Mesh_ID007"


def test_lines_across_splits(spark, tmp_path):
    from cohesia.sources.lines import numbered_lines

    text = "\n".join(f"line {i}" for i in range(5000))
    (tmp_path / "a.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = numbered_lines(spark, str(tmp_path / "a.txt")).toPandas().sort_values("line_no")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.line.tolist() == text.split("\n") and got.line_no.tolist() == list(range(5000))


def test_tables(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes("﻿Patient_ID,Recurrence_Rhythm_2yr\nID01, af\nID02,NR\n".encode())
    got = tb.read_outcomes(spark, str(tmp_path / "o.csv")).orderBy("subject").collect()
    assert [r["outcome"] for r in got] == ["AF", "NR"]
    (tmp_path / "bad.csv").write_text("Patient_ID,Recurrence_Rhythm_2yr\nID01,XX\n")
    with pytest.raises(Exception):
        tb.read_outcomes(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(FileNotFoundError):
        tb.list_inputs(spark, str(tmp_path / "none"), hint="the surface dataset")
    with pytest.raises(ValueError):
        tb.relabel(spark.createDataFrame([(1, 0)], "subject long, y int"), spark.createDataFrame([(2, 0)], "subject long, y int"))
    m = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "a double, b array<double>")
    assert tb.sanitise(m).first() == (None, [1.0, None])
    calls = []

    def fn(t):
        calls.append(t.count())
        return t

    s = spark.range(10).withColumnRenamed("id", "subject")
    tb.with_cache(s.where("subject < 4"), str(tmp_path / "c"), {"k": 1}, fn)
    assert tb.with_cache(s, str(tmp_path / "c"), {"k": 1}, fn).count() == 10 and calls == [4, 6]


def test_signed_rank_is_exact_for_small_groups(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(v)) for g in range(1, 15) for v in np.round(r.normal(0.45, 0.3, g), 1 if g % 2 else 6)]
    rows += [(99, float(v)) for v in r.normal(0.45, 0.3, 80)] + [(100, 0.5)]
    got = {x.g: x for x in st.wilcoxon_less(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    assert 100 not in got
    for g in range(1, 15):
        d = np.array([v - 0.5 for k, v in rows if k == g])
        d = d[d != 0]
        if not len(d):
            assert g not in got
            continue
        rank = pd.Series(np.abs(d)).rank().to_numpy()
        w = rank[d > 0].sum()
        signs = (np.arange(2 ** len(d))[:, None] >> np.arange(len(d))) & 1
        assert got[g].w_plus == pytest.approx(w) and got[g].p == pytest.approx(np.mean(signs @ rank <= w + 1e-9), abs=1e-12)
    assert got[99].p == pytest.approx(1 - 0.5 * math.erfc(got[99].z / 2**0.5), abs=1e-6)


def test_simulated_test_equals_delong(spark, scored):
    _, df = scored
    two = df.withColumn("k", F.col("id") % 2)
    want = {x.k: x.p for x in st.delong(two, ["k"], "y", "a", "b").collect()}
    flat = lambda y: F.flatten(F.collect_list(F.when(F.col("y") == y, F.array("a", "b"))))
    got = {x.k: x.p for x in two.groupBy("k").agg(flat(1).alias("s1"), flat(0).alias("s0")).select("k", st._paired_p(F.col("s1"), F.col("s0")).alias("p")).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_required_size(spark):
    """The search against every size tried one by one, on the same draws."""
    lo, hi, sims, target = 10, 60, 24, 0.6
    cells = [("easy", 0.25, 0.5, 0.5), ("hard", 0.2, 0.1, 0.3), ("never", 0.001, 0.5, 0.5)]
    t = spark.createDataFrame(cells, "cell string, delta double, r double, event_rate double")
    got = {x.cell: x.n for x in st.required_n(t, sims, 3, target, lo, hi).collect()}
    base = st.separation(0.7)
    grid = [(c, n, max(int(n * e + 0.5), 2), st.separation(0.7 + d), base, r) for c, d, r, e in cells for n in range(lo, hi + 1)]
    g = spark.createDataFrame(grid, "cell string, size int, n1 int, mu_a double, mu_b double, r double").withColumn("n0", F.greatest(F.col("size") - F.col("n1"), F.lit(2)))
    g = g.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("k", F.explode(F.expr("sequence(0, n1 + n0 - 1)")))
    g = g.withColumn("y", (F.col("k") < F.col("n1")).cast("int")).withColumn("i", F.when(F.col("y") == 1, F.col("k")).otherwise(F.col("k") - F.col("n1")))
    rows = g.select("cell", "size", "sim", "y", *st._scores(F.col("y"), "r", 3, "cell", "sim", "y", "i"))
    p = st.delong(rows, ["cell", "size", "sim"], "y", "a", "b").groupBy("cell", "size").agg(F.avg((F.col("p") < 0.05).cast("double")).alias("w"))
    power = {(x.cell, x.size): x.w for x in p.collect()}
    for c, *_ in cells:
        a, b = lo - 1, hi + 1
        first = True
        while b - a > 1:
            tried = sorted({int(math.floor((a * (b / a) ** (j / st.PARTS) if first else a + (b - a) * j / st.PARTS) + 0.5)) for j in range(1, st.PARTS)})
            tried = [x for x in tried if a < x < b]
            b = next((x for x in tried if power[c, x] >= target), b)
            a = max([x for x in tried if x < b], default=a)
            first = False
        assert got[c] == (b if b <= hi else None), c
    assert got["never"] is None and got["easy"] is not None
    assert st.required_n(t.limit(0), sims, 3, target, lo, hi).count() == 0


def test_redraws_are_dealt_over_tasks(spark):
    """A short table redrawn many times does not stay in the one task that holds it."""
    df = spark.range(3000).select(F.col("id").alias("doc"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = st.stratified_resample(df, "doc", "y", 2000, 1)
    rows = s.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("times").alias("t")).toPandas()
    assert rows.t.sum() == 6_000_000 and len(rows) >= 5


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 4.0, 2), ("a", 9.0, 1), ("b", 2.0, 1), ("b", 7.0, 1)], "k string, v double, t long")
    for rows in (10, 10**9):
        q = {r.k: r.m for r in quantiles(df, ["k"], "v", {"m": 0.5}, group_rows=rows, weight="t").collect()}
        assert q == {"a": 2.5, "b": 4.5}


def test_list_inputs_of_folders(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    assert len({r.path for r in tb.list_inputs(spark, str(tmp_path), pattern="*.parquet", nested=True).collect()}) == 2


@pytest.mark.parametrize("cell", ["en/3", "ä" * 40, "c" * 61])
def test_runs_of_draws_replay_the_stream(spark, monkeypatch, cell):
    monkeypatch.setattr(rng, "LANES", 64)
    rows = spark.range(7, 1200).select(rng.uniform(77, F.lit(cell), F.lit(3), "id", F.lit("z"), F.lit("a")).alias("u"), rng.normal(77, F.lit(cell), F.lit(3), "id", F.lit("q")).alias("n")).toPandas()
    assert (rng.uniform_runs(f"77|{cell}|3|", 7, 1193, ["|z|a", "|q|b"])[0] == rows["u"]).all()
    assert np.allclose(rng.normal_runs(f"77|{cell}|3|", 7, 1193, "zq")[1], rows["n"], rtol=1e-12, atol=1e-12)
