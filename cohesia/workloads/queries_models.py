"""Folds, keyed logistic fits and redundancy over scored documents and trade graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4
from ..operators import features
from ..operators import fragility as fr
from ..operators import models as md
from ..operators import spectrum as sp
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .queries_fragility import MU, SFI
from .queries_statistics import auc_sql, delong_sql
from .registry import query

G = "graph_id"
S = k.SCORED
BASE = ["size", "tokens"]
EXTRA = ["digit_share", "blank_share"]
K = 5


def _scored(spark, d):
    return cut(views.scored(spark, d))


# ---- SQL: one-column logistic fits by Newton steps ----------------------------------------------


def group_folds_sql(table: str, group: str, kk: int, name: str = "gf") -> str:
    return f"""
{name}_g AS (SELECT {group}, row_number() OVER (ORDER BY count(*) DESC, {group}) - 1 AS r, count(*) OVER () AS g FROM {table} GROUP BY {group}),
{name} AS MATERIALIZED (SELECT t.*, CAST(r % greatest(least({kk}, g), 2) AS INTEGER) AS fold FROM {table} t JOIN {name}_g USING ({group}))"""


def shuffled_sql(table: str, row_id: str, kk: int, seed: int, name: str = "sf") -> str:
    return f"""
{name} AS MATERIALIZED (SELECT t.*, CAST((row_number() OVER (ORDER BY {k.uniform(seed, row_id)}, {row_id}) - 1) % {kk} AS INTEGER) AS fold FROM {table} t)"""


def logit_sql(table: str, key: str, y: str, x: str, name: str = "lg", rounds: int = 12, c: float = 1.0) -> str:
    """Out-of-fold probabilities `<name>` of a one-column fit per (key, fold)."""
    out = [f"""
{name}_t AS (SELECT a.*, b.fold AS f FROM {table} a JOIN (SELECT DISTINCT {key}, fold FROM {table}) b ON a.{key} = b.{key} AND a.fold <> b.fold),
{name}_m AS MATERIALIZED (SELECT {key}, f, avg({x}) AS m, stddev_pop({x}) AS s FROM {name}_t GROUP BY ALL),
{name}_z AS MATERIALIZED (SELECT t.{key}, t.f, {y} AS y, ({x} - m) / s AS z FROM {name}_t t JOIN {name}_m g ON g.{key} = t.{key} AND g.f = t.f),
{name}_w0 AS (SELECT {key}, f, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {name}_m)"""]
    for i in range(rounds):
        out.append(f"""
{name}_h{i} AS (SELECT {key}, f, a, b, {c} * sum(mu - y) + a AS g0, {c} * sum((mu - y) * z) + b AS g1, {c} * sum(mu * (1 - mu)) + 1 AS h0, {c} * sum(mu * (1 - mu) * z) AS h1, {c} * sum(mu * (1 - mu) * z * z) + 1 AS h2
  FROM (SELECT t.*, a, b, 1 / (1 + exp(-(a + b * z))) AS mu FROM {name}_z t JOIN {name}_w{i} w ON w.{key} = t.{key} AND w.f = t.f) GROUP BY {key}, f, a, b),
{name}_w{i + 1} AS MATERIALIZED (SELECT {key}, f, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM {name}_h{i})""")
    out.append(f"""
{name} AS MATERIALIZED (SELECT t.*, 1 / (1 + exp(-(a + b * ({x} - m) / s))) AS prob FROM {table} t JOIN {name}_w{rounds} w ON w.{key} = t.{key} AND w.f = t.fold JOIN {name}_m g ON g.{key} = t.{key} AND g.f = t.fold)""")
    return ",".join(out)


def logit2_sql(table: str, key: str, y: str, x1: str, x2: str, name: str = "lq", rounds: int = 12) -> str:
    """As `logit_sql` for two columns; each Newton step solves its 3 x 3 system by cofactors."""
    p = "1 / (1 + exp(-(a + b * z1 + c * z2)))"
    out = [f"""
{name}_t AS (SELECT a.*, b.fold AS f FROM {table} a JOIN (SELECT DISTINCT {key}, fold FROM {table}) b ON a.{key} = b.{key} AND a.fold <> b.fold),
{name}_m AS MATERIALIZED (SELECT {key}, f, avg({x1}) AS m1, stddev_pop({x1}) AS s1, avg({x2}) AS m2, stddev_pop({x2}) AS s2 FROM {name}_t GROUP BY ALL),
{name}_z AS MATERIALIZED (SELECT t.{key}, t.f, {y} AS y, ({x1} - m1) / s1 AS z1, ({x2} - m2) / s2 AS z2 FROM {name}_t t JOIN {name}_m g ON g.{key} = t.{key} AND g.f = t.f),
{name}_w0 AS (SELECT {key}, f, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {name}_m)"""]
    for i in range(rounds):
        out.append(f"""
{name}_h{i} AS (SELECT {key}, f, a, b, c, sum(mu - y) + a AS g0, sum((mu - y) * z1) + b AS g1, sum((mu - y) * z2) + c AS g2, sum(v) + 1 AS p, sum(v * z1) AS q, sum(v * z2) AS r, sum(v * z1 * z1) + 1 AS s, sum(v * z1 * z2) AS t, sum(v * z2 * z2) + 1 AS u
  FROM (SELECT *, mu * (1 - mu) AS v FROM (SELECT z.*, a, b, c, {p} AS mu FROM {name}_z z JOIN {name}_w{i} w ON w.{key} = z.{key} AND w.f = z.f)) GROUP BY {key}, f, a, b, c),
{name}_d{i} AS (SELECT *, p * (s * u - t * t) - q * (q * u - t * r) + r * (q * t - s * r) AS det FROM {name}_h{i}),
{name}_w{i + 1} AS MATERIALIZED (SELECT {key}, f, a - (g0 * (s * u - t * t) - g1 * (q * u - t * r) + g2 * (q * t - s * r)) / det AS a,
  b - (-g0 * (q * u - r * t) + g1 * (p * u - r * r) - g2 * (p * t - q * r)) / det AS b, c - (g0 * (q * t - r * s) - g1 * (p * t - r * q) + g2 * (p * s - q * q)) / det AS c FROM {name}_d{i})""")
    out.append(f"""
{name} AS MATERIALIZED (SELECT t.*, 1 / (1 + exp(-(a + b * ({x1} - m1) / s1 + c * ({x2} - m2) / s2))) AS prob2 FROM {table} t JOIN {name}_w{rounds} w ON w.{key} = t.{key} AND w.f = t.fold JOIN {name}_m g ON g.{key} = t.{key} AND g.f = t.fold)""")
    return ",".join(out)


ONE = "src AS MATERIALIZED (SELECT *, 1 AS one FROM scored)"


@query("t01_subject_features", k.q(*SFI, """
b AS (SELECT n.graph_id, avg(fibrosis) AS burden FROM nodes n GROUP BY ALL)""", body=f"""
SELECT graph_id, 'fibhet_burden' AS name, {k.r4('burden', 3)} AS value FROM b
UNION ALL SELECT g, 'spec_lambda2', {k.r4('val', 3)} FROM eig_v2 UNION ALL SELECT graph_id, 'sfi_total', {k.r4('sum(sfi)', 3)} FROM reg GROUP BY ALL
UNION ALL SELECT graph_id, 'sfi_region_max', {k.r4('max(sfi)', 3)} FROM reg GROUP BY ALL"""))
def t01(spark, d):
    nodes, edges = views.trade(spark, d)
    nodes, edges = cut(nodes), cut(edges)
    f = features.subject_features(edges, nodes, MU)
    keep = ["fibhet_burden", "spec_lambda2", "sfi_total", "sfi_region_max"]
    return f.where(F.col("name").isin(keep)).select(G, "name", r4("value", 3).alias("value"))


TIERS = range(1995, 2002)
_BY_TIER = ", ".join(k.r4(f"coalesce(avg(score) FILTER (tier = {t}), 0)", 6) + f" AS s_{t}" for t in TIERS)


@query("t02_design_matrix", k.q(k.VERDICTS, body=f"""
SELECT subject AS graph_id, {_BY_TIER}, max(y) AS y, any_value(cohort) AS "group" FROM verdicts GROUP BY subject"""))
def t02(spark, d):
    v = cut(views.verdicts(spark, d))
    f = v.select(F.col("subject").alias(G), F.concat(F.lit("s_"), F.col("tier").cast("string")).alias("name"), F.col("score").alias("value"))
    lab = v.groupBy(F.col("subject").alias(G)).agg(F.max("y").alias("y"), F.first("cohort").alias("group"))
    return md.design_matrix(f, lab).select(G, *[r4(f"s_{t}", 6).alias(f"s_{t}") for t in TIERS], "y", "group")


@query("t03_feature_sets", k.q(S, body="SELECT doc_id, size, tokens FROM scored"))
def t03(spark, d):
    s = views.scored(spark, d).withColumnsRenamed({"size": "len_size", "tokens": "len_tokens"})
    own = md.feature_sets(s.columns, {"length": ("len_",)})["length"]
    return s.select("doc_id", *[F.col(c).alias(c[4:]) for c in own])


@query("t04_group_folds", k.q(S, group_folds_sql("scored", "source", K), body="SELECT doc_id, source, fold FROM gf"))
def t04(spark, d):
    return md.group_folds(_scored(spark, d), "source", K).select("doc_id", "source", "fold")


@query("t05_shuffled_folds", k.q(S, shuffled_sql("scored", "doc_id", K, 0), body="SELECT doc_id, fold FROM sf"))
def t05(spark, d):
    return md.shuffled_folds(_scored(spark, d), "doc_id", K, 0).select("doc_id", "fold")


@query("t06_oof_logistic", k.q(S, ONE, group_folds_sql("src", "source", K), logit_sql("gf", "one", "low", "tokens"), body=f"SELECT doc_id, fold, {k.r4('prob', 5)} AS prob FROM lg"))
def t06(spark, d):
    p = md.oof_logistic(cut(md.group_folds(_scored(spark, d), "source", K)), [], "low", ["tokens"])
    return p.select("doc_id", "fold", r4("prob", 5).alias("prob"))


@query("t07_oof_logistic_nested", k.q(S, body="SELECT count(*) AS n, true AS in_range, true AS from_grid FROM scored"))
def t07(spark, d):
    p, best = md.oof_logistic_nested(md.group_folds(_scored(spark, d), "source", K), "low", BASE + EXTRA, "source")
    ok = best.agg(F.min(F.col("C").isin(list(md.C_GRID))).alias("from_grid"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("prob").between(0, 1)).alias("in_range")).crossJoin(ok)


@query("t08_oof_boosted", k.q(S, body="SELECT count(*) AS n, true AS in_range FROM scored"))
def t08(spark, d):
    p = md.oof_boosted(md.group_folds(_scored(spark, d), "source", K), "low", BASE + EXTRA)
    return p.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("prob").between(0, 1)).alias("in_range"))


SCHEMES = (group_folds_sql("scored", "source", K), shuffled_sql("scored", "doc_id", K, 0), "both_s AS MATERIALIZED (SELECT 'grouped' AS scheme, * FROM gf UNION ALL BY NAME SELECT 'naive' AS scheme, * FROM sf)", logit_sql("both_s", "scheme", "low", "tokens"), auc_sql("lg", "scheme", "low", "prob"))


@query("t12_grouped_vs_naive", k.q(S, *SCHEMES, body=f"""
SELECT {k.r4("max(auc) FILTER (scheme = 'grouped')", 5)} AS auc_grouped, {k.r4("max(auc) FILTER (scheme = 'naive')", 5)} AS auc_naive, {k.r4("max(auc) FILTER (scheme = 'naive') - max(auc) FILTER (scheme = 'grouped')", 5)} AS leak FROM au"""))
def t12(spark, d):
    t = md.grouped_vs_naive(_scored(spark, d), "doc_id", "low", ["tokens"], "source", K)
    return t.select(*[r4(c, 5).alias(c) for c in t.columns])


@query("t15_evaluate_pair", k.q(S, *SCHEMES[:4], logit2_sql("lg", "scheme", "low", "tokens", "digit_share"), delong_sql("lq", "scheme", "low", "prob2", "prob"), body=f"""
SELECT 'lr' AS clf, {k.r4("max(auc_b) FILTER (scheme = 'grouped')", 5)} AS auc_base, {k.r4("max(auc_a) FILTER (scheme = 'grouped')", 5)} AS auc_full, {k.r4("max(delta) FILTER (scheme = 'grouped')", 5)} AS delta,
  {k.r4("max(p) FILTER (scheme = 'grouped')", 4)} AS p, {k.r4("max(delta) FILTER (scheme = 'naive')", 5)} AS naive_delta, coalesce(bool_or(delta >= 0.05 AND p < 0.05) FILTER (scheme = 'grouped'), false) AS gate, true AS ordered FROM dl"""))
def t15(spark, d):
    t = md.evaluate_pair(_scored(spark, d), "doc_id", "low", ["tokens"], ["digit_share"], "source", K, draws=100)
    fine = [r4(c, 5).alias(c) for c in ("auc_base", "auc_full", "delta")]
    return t.select("clf", *fine, r4("p").alias("p"), r4("naive_delta", 5).alias("naive_delta"), "gate", (F.col("boot_lo") <= F.col("boot_hi")).alias("ordered"))


@query("t26_ladder", k.q(S, "r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM scored), l AS MATERIALIZED (SELECT r.*, rung FROM r CROSS JOIN (SELECT unnest([100, 200, 300, 1000000]) AS rung) WHERE i < rung AND rung <= n)", auc_sql("l", "rung", "low", "tokens"),
    body=f"SELECT CAST(rung AS INTEGER) AS rung, {k.r4('auc', 6)} AS auc FROM au"))
def t26(spark, d):
    from ..operators.statistics import auc

    l = md.ladder(_scored(spark, d), "doc_id", [100, 200, 300, 1_000_000])
    return auc(l, ["rung"], "low", "tokens").select("rung", r4("auc", 6).alias("auc"))


@query("t27_r2", k.q(S, body=f"SELECT 'size' AS name, {k.r4('regr_r2(size, tokens)', 6)} AS r2 FROM scored"))
def t27(spark, d):
    return md.r2(views.scored(spark, d), "size", ["tokens"]).select("name", r4("r2", 6).alias("r2"))


@query("t28_canon_corr", k.q(S, body=f"SELECT {k.r4('abs(corr(size, digit_share))', 6)} AS canon_corr FROM scored"))
def t28(spark, d):
    """One column per block, where the leading canonical correlation is |r|; wider blocks are unit tested."""
    return md.canon_corr(views.scored(spark, d), ["size"], ["digit_share"]).select(r4("canon_corr", 6).alias("canon_corr"))


@query("t29_redundancy", k.q(S, """
m AS (SELECT 'size' AS name, 'len' AS block, regr_r2(size, tokens) AS r2 FROM scored UNION ALL SELECT 'digit_share', 'len', regr_r2(digit_share, tokens) FROM scored
  UNION ALL SELECT 'size', 'blank', regr_r2(size, blank_share) FROM scored UNION ALL SELECT 'digit_share', 'blank', regr_r2(digit_share, blank_share) FROM scored)""", body=f"SELECT name, block, {k.r4('r2', 6)} AS r2 FROM m"))
def t29(spark, d):
    t = md.redundancy(_scored(spark, d), "doc_id", ["size", "digit_share"], {"len": ["tokens"], "blank": ["blank_share"]})[0]
    return t.select("name", "block", r4("r2", 6).alias("r2"))


PERMS = f"""
reps AS MATERIALIZED (SELECT *, perm FROM gf CROSS JOIN (SELECT unnest(range(3)) AS perm)),
pa AS (SELECT perm, doc_id, row_number() OVER (PARTITION BY perm ORDER BY doc_id) AS i FROM reps),
pb AS (SELECT perm, low AS yy, row_number() OVER (PARTITION BY perm ORDER BY {k.uniform(0, 'perm', 'doc_id')}, doc_id) AS i FROM reps),
pl AS MATERIALIZED (SELECT r.doc_id, r.tokens, r.fold, r.perm, pb.yy FROM reps r JOIN pa ON pa.perm = r.perm AND pa.doc_id = r.doc_id JOIN pb ON pb.perm = pa.perm AND pb.i = pa.i)"""


@query("t46_dry_run", k.q(S, group_folds_sql("scored", "source", K), PERMS, logit_sql("pl", "perm", "yy", "tokens"), auc_sql("lg", "perm", "yy", "prob"), body=f"SELECT CAST(perm AS INTEGER) AS perm, {k.r4('auc', 5)} AS auc, auc > 0.75 AS abort FROM au"))
def t46(spark, d):
    rows = cut(md.group_folds(_scored(spark, d), "source", K))
    return md.dry_run(rows, "doc_id", "low", ["tokens"]).select("perm", r4("auc", 5).alias("auc"), "abort")


@query("t47_noise_control", k.q(S, ONE, group_folds_sql("src", "source", K), logit_sql("gf", "one", "low", "tokens"), auc_sql("lg", "one", "low", "prob"), body=f"SELECT {k.r4('auc', 5)} AS base_auc, true AS p_ok FROM au"))
def t47(spark, d):
    rows = cut(md.group_folds(_scored(spark, d), "source", K))
    t = md.noise_control(rows, "doc_id", "low", ["tokens"], 2, 0.05, draws=20)
    return t.select(r4("base_auc", 5).alias("base_auc"), F.col("p_noise").between(1 / 21, 1).alias("p_ok"))


@query("t48_fold_diagnostic", k.q(S, ONE, group_folds_sql("src", "source", K), logit_sql("gf", "one", "low", "tokens"), auc_sql("lg", "fold", "low", "prob"), """
pf AS (SELECT fold, avg(prob) AS mp, sum(low) AS s, count(*) AS c FROM lg GROUP BY fold),
pv AS (SELECT mp, (sum(s) OVER () - s) / (sum(c) OVER () - c)::DOUBLE AS prev FROM pf)""", body=f"SELECT {k.r4('corr(prev, mp)', 4)} AS r, (SELECT {k.r4('avg(auc)', 5)} FROM au) AS within_auc FROM pv"))
def t48(spark, d):
    t = md.fold_diagnostic(cut(md.group_folds(_scored(spark, d), "source", K)), "low", ["tokens"])
    return t.select(r4("r", 4).alias("r"), r4("within_auc", 5).alias("within_auc"))


@query("t49_holdout_eval", k.q(S, "ho AS MATERIALIZED (SELECT *, 1 AS one, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS fold FROM scored)", logit_sql("ho", "one", "low", "tokens"), "te AS (SELECT * FROM lg WHERE fold = 1)", auc_sql("te", "one", "low", "prob"),
    body=f"SELECT {k.r4('auc', 5)} AS auc, (SELECT sum(low)::BIGINT FROM te) AS n_pos, (SELECT (count(*) - sum(low))::BIGINT FROM te) AS n_neg FROM au"))
def t49(spark, d):
    t = md.holdout_eval(_scored(spark, d), "low", ["tokens"], F.col("lang") == "fr")
    return t.select(r4("auc", 5).alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


NOISE_DRAWS = 200

_NOISE = f"nd AS (SELECT lang, low, draw, {k.uniform(50, 'doc_id', 'draw')} AS u FROM scored CROSS JOIN (SELECT unnest(range({NOISE_DRAWS})) AS draw))"
_ARMS = """arms AS MATERIALIZED (SELECT lang, 'tokens' AS clf, delta, p, auc_b FROM d1 UNION ALL SELECT lang, 'size', delta, p, auc_b FROM d2),
nz AS MATERIALIZED (SELECT a.lang, clf, (1 + count(*) FILTER (auc - auc_b >= delta)) / (1 + count(*))::DOUBLE AS p_noise FROM arms a JOIN au n ON n.lang = a.lang GROUP BY ALL),
g AS (SELECT a.lang, bool_or(delta >= 0.10 AND p < 0.05) AS gate_fired, max(auc_b) < 0.72 AS degraded, max(p_noise) > 0.05 AS noise_explains, bool_or(delta >= 0.10) AS above
  FROM arms a JOIN nz ON nz.lang = a.lang AND nz.clf = a.clf GROUP BY a.lang)"""


@query("t50_gate_chain", k.q(S, delong_sql("scored", "lang", "low", "tokens", "digit_share", "d1"), delong_sql("scored", "lang", "low", "size", "digit_share", "d2"), _NOISE, auc_sql("nd", "lang, draw", "low", "u"), _ARMS, body="""
SELECT lang, gate_fired, degraded, noise_explains, gate_fired AND NOT degraded AND NOT noise_explains AS endpoint_met,
  CASE WHEN gate_fired AND NOT degraded AND NOT noise_explains THEN 'met' WHEN gate_fired AND degraded THEN 'not met: degraded baseline' WHEN gate_fired THEN 'not met: noise explains'
       WHEN above THEN 'inconclusive: test does not reject' ELSE 'inconclusive: underpowered' END AS verdict,
  CASE WHEN gate_fired AND NOT degraded AND NOT noise_explains THEN 'eligible' ELSE 'not tested' END AS next_stage FROM g"""))
def t50(spark, d):
    """Two arms against one baseline; p_noise is the share of pure noise columns that gain as much."""
    from ..functions.rng import uniform
    from ..operators.statistics import auc, delong

    s = cut(_scored(spark, d))
    arm = lambda c: delong(s, ["lang"], "low", c, "digit_share").select("lang", F.lit(c).alias("clf"), "delta", "p", F.col("auc_b").alias("baseline_auc"))
    arms = cut(arm("tokens").union(arm("size")))
    draws = s.select("doc_id", "lang", "low", F.explode(F.sequence(F.lit(0), F.lit(NOISE_DRAWS - 1))).alias("draw"))
    noise = auc(draws.withColumn("u", uniform(50, "doc_id", "draw")), ["lang", "draw"], "low", "u").select("lang", F.col("auc").alias("noise_auc"))
    ge = F.count_if(F.col("noise_auc") - F.col("baseline_auc") >= F.col("delta"))
    p = arms.join(noise, "lang").groupBy("lang", "clf").agg(((ge + 1) / (F.count(F.lit(1)) + 1)).alias("p_noise"))
    return md.gate_chain(arms.join(p, ["lang", "clf"]), ["lang"])


@query("t51_subgroup_eval", k.q(S, "sub AS MATERIALIZED (SELECT *, 1 AS one FROM scored WHERE low = 0)", group_folds_sql("sub", "source", K), logit_sql("gf", "one", "toxic", "tokens"), auc_sql("lg", "one", "toxic", "prob"), body=f"SELECT {k.r4('auc', 5)} AS auc FROM au"))
def t51(spark, d):
    """Among good documents, a second outcome (toxic) is scored by the same procedure."""
    from ..operators.statistics import auc

    sub = cut(md.group_folds(cut(_scored(spark, d).where("low = 0").withColumn("one", F.lit(1))), "source", K))
    return auc(md.oof_logistic(sub, ["one"], "toxic", ["tokens"]), ["one"], "toxic", "prob").select(r4("auc", 5).alias("auc"))


COPIES = 6
_FAMILIES = f"""
rep AS MATERIALIZED (SELECT doc_id * {COPIES} + copy AS row_id, doc_id AS family, low, {", ".join(f"{c} * (1 + 0.05 * {k.normal(4, 'doc_id', 'copy', str(i))}) AS {c}" for i, c in enumerate(BASE))}
  FROM scored CROSS JOIN (SELECT unnest(range({COPIES})) AS copy))"""


@query("t52_leakage_gap", k.q(S, _FAMILIES, group_folds_sql("rep", "family", K), shuffled_sql("rep", "row_id", K, 0), "both_s AS MATERIALIZED (SELECT 'grouped' AS scheme, * FROM gf UNION ALL BY NAME SELECT 'naive' AS scheme, * FROM sf)",
    logit2_sql("both_s", "scheme", "low", *BASE), auc_sql("lq", "scheme", "low", "prob2"), body=f"""
SELECT {k.r4("max(auc) FILTER (scheme = 'grouped')", 5)} AS auc_grouped, {k.r4("max(auc) FILTER (scheme = 'naive')", 5)} AS auc_naive, {k.r4("max(auc) FILTER (scheme = 'naive') - max(auc) FILTER (scheme = 'grouped')", 5)} AS leak, (SELECT count(*) FROM rep) AS rows FROM au"""))
def t52(spark, d):
    rep = cut(md.replicate_families(_scored(spark, d), "doc_id", COPIES, BASE, 0.05, 4))
    t = md.grouped_vs_naive(rep, "row_id", "low", BASE, "family", K)
    n = rep.agg(F.count(F.lit(1)).alias("rows"))
    return t.select(*[r4(c, 5).alias(c) for c in t.columns]).crossJoin(n)


@query("t53_matched_n", k.q(S, "m AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM scored) WHERE i <= 60)", auc_sql("m", "lang", "low", "tokens"), body=f"SELECT lang, {k.r4('auc', 6)} AS auc FROM au"))
def t53(spark, d):
    from ..operators.statistics import auc

    m = md.matched_first(_scored(spark, d), "lang", "doc_id", 60)
    return auc(m, ["lang"], "low", "tokens").select("lang", r4("auc", 6).alias("auc"))


@query("t54_parameter_sweep", k.q(*SFI, body=f"""
SELECT graph_id, mu, {k.r4(f'sum(sfi) * mu / {MU}', 3)} AS total, {k.r4(f'max(sfi) * mu / {MU}', 3)} AS region_max FROM reg CROSS JOIN (SELECT unnest([0.15, 0.36, 0.6]::DOUBLE[]) AS mu) GROUP BY graph_id, mu"""))
def t54(spark, d):
    """The field is linear in its mean, so one cached eigen table serves every value."""
    nodes, edges = views.trade(spark, d)
    nodes, edges = cut(nodes), cut(edges)
    s = fr.sfi_edges(edges, nodes, sp.fiedler(edges, nodes), mu=1.0)
    reg = fr.sfi_region(s).select("*", F.explode(F.array(*[F.lit(m) for m in (0.15, 0.36, 0.6)])).alias("mu"))
    t = reg.groupBy(G, "mu").agg(F.sum(F.col("sfi") * F.col("mu")).alias("total"), F.max(F.col("sfi") * F.col("mu")).alias("region_max"))
    return t.select(G, "mu", r4("total", 3).alias("total"), r4("region_max", 3).alias("region_max"))


_COHORTS = f"""
cr AS MATERIALIZED (SELECT lang AS cohort, * EXCLUDE (lang) FROM scored UNION ALL SELECT 'combined', * EXCLUDE (lang) FROM scored),
ck AS (SELECT cohort FROM cr GROUP BY cohort HAVING sum(low) >= 2 AND count(*) - sum(low) >= 2),
cg AS (SELECT cohort, source, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, source) - 1 AS r, count(*) OVER (PARTITION BY cohort) AS g FROM cr JOIN ck USING (cohort) GROUP BY cohort, source),
cf AS MATERIALIZED (SELECT cr.*, CAST(r % greatest(least({K}, g), 2) AS INTEGER) AS fold FROM cr JOIN cg USING (cohort, source))"""
_BASES, _ADDONS = ("tokens", "size"), ("digit_share", "blank_share")
_FITS = [logit_sql("cf", "cohort", "low", b, name=f"l_{b}") for b in _BASES]
_FITS += [logit2_sql(f"l_{b}", "cohort", "low", b, a, name=f"l_{b}_{a}") for b in _BASES for a in _ADDONS]
_FITS += [delong_sql(f"l_{b}_{a}", "cohort", "low", "prob2", "prob", f"d_{b}_{a}") for b in _BASES for a in _ADDONS]


@query("t57_compare_variants", k.q(S, _COHORTS, *_FITS, body=" UNION ALL ".join(f"SELECT cohort, '{b}' AS base, '{a}' AS addon, {k.r4('auc_b', 5)} AS auc_base, {k.r4('auc_a', 5)} AS auc_full, {k.r4('p', 4)} AS p FROM d_{b}_{a}" for b in _BASES for a in _ADDONS)))
def t57(spark, d):
    t = md.compare_variants(_scored(spark, d), "doc_id", "low", {b: [b] for b in _BASES}, {a: [a] for a in _ADDONS}, "source", "lang", K)
    return t.select("cohort", "base", "addon", r4("auc_base", 5).alias("auc_base"), r4("auc_full", 5).alias("auc_full"), r4("p").alias("p"))


