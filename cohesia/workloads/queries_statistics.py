"""Exact statistics over scored documents and per-customer yearly verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4
from ..functions.tails import ERFC, binom_ci, mcnemar
from ..operators import statistics as st
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .registry import query

S, V = k.SCORED, k.VERDICTS
YEARS = (1995, 1996, 1997, 1998)


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + {x} / 2))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def delong_sql(table: str, keys: str, y: str, a: str, b: str, name: str = "dl") -> str:
    """Placements by windows, then the paired variance."""
    def place(s, t):
        other = f"sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END)" , f"sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END)"
        win = f"OVER (PARTITION BY {keys} ORDER BY {s} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        tie = f"OVER (PARTITION BY {keys}, {s})"
        return f"{other[0]} {win} - ({other[0]} {tie}) / 2.0::DOUBLE AS {t}n, {other[1]} {win} - ({other[1]} {tie}) / 2.0::DOUBLE AS {t}p"

    return f"""
{name}_p AS MATERIALIZED (SELECT {keys}, {y} AS y, {place(a, 'a')}, {place(b, 'b')}, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) AS m, sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys}) AS n FROM {table}),
{name}_v AS (SELECT {keys}, y, m, n, CASE WHEN y = 1 THEN an / n ELSE 1 - ap / m END AS va, CASE WHEN y = 1 THEN bn / n ELSE 1 - bp / m END AS vb FROM {name}_p WHERE m > 0 AND n > 0),
{name}_s AS (SELECT {keys}, avg(va) FILTER (y = 1) AS auc_a, avg(vb) FILTER (y = 1) AS auc_b, coalesce(var_samp(va - vb) FILTER (y = 1), 0) / any_value(m) + coalesce(var_samp(va - vb) FILTER (y <> 1), 0) / any_value(n) AS var FROM {name}_v GROUP BY {keys}),
{name} AS MATERIALIZED (SELECT *, auc_a - auc_b AS delta, CASE WHEN var > 0 THEN (auc_a - auc_b) / sqrt(var) ELSE 0 END AS z,
  CASE WHEN var > 0 THEN {erfc_sql("(abs((auc_a - auc_b) / sqrt(var)) / sqrt(2::DOUBLE))")} ELSE 1 END AS p FROM {name}_s)"""


def auc_sql(table: str, keys: str, y: str, s: str, name: str = "au") -> str:
    return f"""
{name}_r AS (SELECT {keys}, {y} AS y, rank() OVER (PARTITION BY {keys} ORDER BY {s}) + (count(*) OVER (PARTITION BY {keys}, {s}) - 1) / 2.0::DOUBLE AS r FROM {table}),
{name} AS MATERIALIZED (SELECT {keys}, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auc FROM {name}_r GROUP BY {keys})"""


def _pool(spark, d):
    return views.scored(spark, d).withColumn("one", F.lit(1))


POOL = S + ",\npool AS MATERIALIZED (SELECT *, 1 AS one FROM scored)"


@query("t09_auc", k.q(S, auc_sql("scored", "lang", "low", "tokens"), body=f"SELECT lang, {k.r4('auc', 6)} AS auc FROM au"))
def t09(spark, d):
    return st.auc(views.scored(spark, d), ["lang"], "low", "tokens").select("lang", r4("auc", 6).alias("auc"))


@query("t10_midrank", k.q(S, body=f"""
SELECT doc_id, {k.r4("rank() OVER (PARTITION BY lang ORDER BY tokens) + (count(*) OVER (PARTITION BY lang, tokens) - 1) / 2.0::DOUBLE")} AS midrank FROM scored"""))
def t10(spark, d):
    return st.midrank(views.scored(spark, d), ["lang"], "tokens").select("doc_id", r4("midrank").alias("midrank"))


@query("t10_midrank_global", k.q(body="""
SELECT l_quantity, count(*) AS cnt, round(any_value(r), 4) + 0.0::DOUBLE AS midrank FROM (
  SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem) GROUP BY l_quantity""").replace("WITH \n", ""))
def t10g(spark, d):
    """Keyless ranks of every line: ties collapse before anything is ordered."""
    from ..plans.ordered import midranks

    t = midranks(views.table(spark, d, "lineitem"), [], "l_quantity", {"cnt": F.lit(1)})
    return t.select("l_quantity", "cnt", r4(F.col("cnt_below") + (F.col("cnt") + 1) / 2).alias("midrank"))


@query("t11_delong", k.q(S, delong_sql("scored", "lang", "low", "tokens", "digit_share"), body=f"""
SELECT lang, {k.r4('auc_a', 6)} AS auc_a, {k.r4('auc_b', 6)} AS auc_b, {k.r4('delta', 6)} AS delta, {k.r4('z')} AS z, {k.r4('p')} AS p FROM dl"""))
def t11(spark, d):
    t = st.delong(views.scored(spark, d), ["lang"], "low", "tokens", "digit_share")
    return t.select("lang", *[r4(c, 6).alias(c) for c in ("auc_a", "auc_b", "delta")], r4("z").alias("z"), r4("p").alias("p"))


B = 100
BOOT = f"""
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY low ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY low) AS n FROM scored),
picks AS (SELECT rep, low, least(floor({k.uniform(42, 'rep', 'low', 'i')} * n), n - 1) AS pk FROM num CROSS JOIN (SELECT unnest(range({B})) AS rep)),
boot AS MATERIALIZED (SELECT p.rep, s.low, s.tokens, s.digit_share FROM picks p JOIN num s ON s.low = p.low AND s.i = p.pk)"""


@query("t13_auc_ci", k.q(POOL, BOOT, auc_sql("boot", "rep", "low", "tokens"), auc_sql("pool", "one", "low", "tokens", "pt"), body=f"""
SELECT {k.r4('quantile_cont(auc, 0.025)', 5)} AS lo, {k.r4('quantile_cont(auc, 0.975)', 5)} AS hi, {k.r4('stddev_samp(auc)', 5)} AS se, count(auc) AS n_valid, (SELECT {k.r4('auc', 5)} FROM pt) AS auc FROM au"""))
def t13(spark, d):
    t = st.auc_ci(cut(views.scored(spark, d)), "doc_id", "low", "tokens", B, 42)
    return t.select(*[c if c == "n_valid" else r4(c, 5).alias(c) for c in t.columns])


@query("t14_delta_auc_boot", k.q(S, BOOT, auc_sql("boot", "rep", "low", "tokens", "ua"), auc_sql("boot", "rep", "low", "digit_share", "ub"), "dd AS (SELECT ua.auc - ub.auc AS d FROM ua JOIN ub USING (rep))", body=f"""
SELECT {k.r4('avg(d)', 5)} AS mean, {k.r4('avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END)')} AS p_le_0, count(d) AS n_valid, {k.r4('quantile_cont(d, 0.025)', 5)} AS lo, {k.r4('quantile_cont(d, 0.975)', 5)} AS hi FROM dd"""))
def t14(spark, d):
    t = st.delta_auc_boot(cut(views.scored(spark, d)), "doc_id", "low", "tokens", "digit_share", B, 42)
    return t.select(*[c if c == "n_valid" else r4(c, 5).alias(c) for c in t.columns])


PROB = S + ",\nprob AS MATERIALIZED (SELECT *, least(blank_share * 3, 1.0)::DOUBLE AS prob FROM scored)"


def _prob(spark, d):
    return views.scored(spark, d).withColumn("prob", F.least(F.col("blank_share") * 3, F.lit(1.0)))


BINS = "bt AS (SELECT lang, least(len(list_filter([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[], lambda e: e <= prob)), 9) AS bin, prob, low FROM prob)"


@query("t16_calibration", k.q(PROB, BINS, body=f"SELECT lang, CAST(bin AS INTEGER) AS bin, {k.r4('avg(prob)', 6)} AS mean_pred, {k.r4('avg(low)', 6)} AS rate, count(*) AS cnt FROM bt GROUP BY lang, bin"))
def t16(spark, d):
    t = st.calibration(_prob(spark, d), ["lang"], "low", "prob")[0]
    return t.select("lang", "bin", r4("mean_pred", 6).alias("mean_pred"), r4("rate", 6).alias("rate"), "cnt")


@query("t16_brier_ece", k.q(PROB, BINS, "tb AS (SELECT lang, bin, avg(prob) AS mp, avg(low) AS rt, count(*) AS c, sum((prob - low)**2) AS sq FROM bt GROUP BY ALL)", body=f"""
SELECT lang, {k.r4('sum(sq) / sum(c)', 6)} AS brier, {k.r4('sum(c * abs(rt - mp)) / sum(c)', 6)} AS ece FROM tb GROUP BY lang"""))
def t16b(spark, d):
    t = st.calibration(_prob(spark, d), ["lang"], "low", "prob")[1]
    return t.select("lang", r4("brier", 6).alias("brier"), r4("ece", 6).alias("ece"))


def signed_rank_sql(groups: str, exact: bool) -> str:
    """CTEs up to sr(g, n, w_plus, p) from `groups`, a select of (g, dd): the null of small groups is built up rank by rank."""
    small = f"""
rk AS MATERIALIZED (SELECT r.g, row_number() OVER (PARTITION BY r.g ORDER BY r) AS i, CAST(2 * r AS BIGINT) AS r2 FROM r JOIN st USING (g) WHERE n <= {st.EXACT_RANKS}),
conv AS (SELECT g, 0::BIGINT AS i, 0::BIGINT AS s, 1.0::DOUBLE AS ch FROM st WHERE n <= {st.EXACT_RANKS}
  UNION ALL SELECT g, i, s, sum(ch) FROM (SELECT conv.g, rk.i, conv.s + rk.r2 * b AS s, ch / 2 AS ch FROM conv JOIN rk ON rk.g = conv.g AND rk.i = conv.i + 1 CROSS JOIN (SELECT unnest([0, 1]) AS b)) GROUP BY g, i, s),
ex AS (SELECT st.g, sum(ch) AS p FROM st JOIN conv ON conv.g = st.g AND conv.i = st.n AND conv.s <= 2 * st.w_plus GROUP BY st.g),"""
    half = erfc_sql("(abs(z) / sqrt(2::DOUBLE))")
    return f"""
d AS ({groups}),
r AS MATERIALIZED (SELECT g, dd, count(*) OVER (PARTITION BY g, abs(dd)) AS c, rank() OVER (PARTITION BY g ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY g, abs(dd)) - 1) / 2.0::DOUBLE AS r FROM d WHERE dd <> 0),
st AS MATERIALIZED (SELECT g, count(*) AS n, sum(CASE WHEN dd > 0 THEN r ELSE 0 END) AS w_plus, sum(c::DOUBLE * c - 1) AS tie FROM r GROUP BY g),{small if exact else ''}
nz AS (SELECT *, (w_plus - n * (n + 1) / 4.0::DOUBLE) / nullif(sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - tie / 48), 0) AS z FROM st),
sr AS (SELECT nz.g, n, w_plus, {'coalesce(ex.p, ' if exact else '('}CASE WHEN z >= 0 THEN 1 - {half} / 2 ELSE {half} / 2 END) AS p FROM nz{' LEFT JOIN ex USING (g)' if exact else ''})"""


_CENTRED = "SELECT {g} AS g, cov / 10000 - 0.5 AS dd FROM (SELECT DISTINCT subject, cohort, cov FROM verdicts)"


@query("t24_wilcoxon", k.q(V, signed_rank_sql(_CENTRED.format(g="cohort"), False), body=f"""
SELECT g AS cohort, n, {k.r4('w_plus')} AS w_plus, {k.r4('p', 6)} AS p FROM sr"""))
def t24(spark, d):
    v = views.verdicts(spark, d).select("subject", "cohort", (F.col("cov") / 10000).alias("s")).distinct()
    return st.wilcoxon_less(v, ["cohort"], "s").select("cohort", "n", r4("w_plus").alias("w_plus"), r4("p", 6).alias("p"))


@query("t24_wilcoxon_small", k.q(V, signed_rank_sql(_CENTRED.format(g="cohort || '/' || (subject % 25)"), True), body=f"""
SELECT g, n, {k.r4('w_plus')} AS w_plus, {k.r4('p', 6)} AS p FROM sr""", recursive=True))
def t24s(spark, d):
    """Groups by segment and customer number: the exact null where they are small."""
    v = views.verdicts(spark, d).select("subject", F.concat_ws("/", "cohort", (F.col("subject") % 25).cast("string")).alias("g"), (F.col("cov") / 10000).alias("s")).distinct()
    return st.wilcoxon_less(v, ["g"], "s").select("g", "n", r4("w_plus").alias("w_plus"), r4("p", 6).alias("p"))


CI = """
kn AS MATERIALIZED (SELECT cohort, tier, sum(y)::BIGINT AS k, count(*) AS n FROM verdicts GROUP BY ALL),
lf AS MATERIALIZED (SELECT cohort, tier, k, n, i, lgamma(n + 1.0::DOUBLE) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1.0::DOUBLE) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1.0::DOUBLE) END AS lc FROM kn CROSS JOIN LATERAL (SELECT unnest(range(n + 1)) AS i)),
bi AS (SELECT 0 AS it, cohort, tier, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d FROM kn
  UNION ALL SELECT it + 1, cohort, tier, CASE WHEN up < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN up < 0.025 THEN b ELSE (a + b) / 2 END,
    CASE WHEN dn > 0.025 THEN (c + d) / 2 ELSE c END, CASE WHEN dn > 0.025 THEN d ELSE (c + d) / 2 END FROM (
    SELECT it, cohort, tier, a, b, c, d, sum(CASE WHEN i >= k THEN exp(lc + i * ln((a+b)/2) + (n-i) * ln(1-(a+b)/2)) ELSE 0 END) AS up,
      sum(CASE WHEN i <= k THEN exp(lc + i * ln((c+d)/2) + (n-i) * ln(1-(c+d)/2)) ELSE 0 END) AS dn FROM bi JOIN lf USING (cohort, tier) WHERE it < 40 GROUP BY ALL))"""


@query("t30_binom_ci", k.q(V, CI, body=f"""
SELECT cohort, tier, k, n, {k.r4('arg_max(a, it)', 5)} AS lo, {k.r4('arg_max(c, it)', 5)} AS hi FROM bi JOIN kn USING (cohort, tier) GROUP BY ALL""", recursive=True))
def t30(spark, d):
    v = views.verdicts(spark, d).groupBy("cohort", "tier").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    c = v.withColumn("ci", binom_ci(F.col("k"), F.col("n")))
    return c.select("cohort", "tier", "k", "n", r4("ci.lo", 5).alias("lo"), r4("ci.hi", 5).alias("hi"))


def mcnemar_sql(b: str, c: str) -> str:
    return f"""least(1.0::DOUBLE, CASE WHEN {b} + {c} = 0 THEN 1.0::DOUBLE ELSE 2 * list_sum(list_transform(range(least({b}, {c}) + 1), lambda i: exp(
  lgamma({b} + {c} + 1.0::DOUBLE) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1.0::DOUBLE) END - lgamma({b} + {c} - i + 1.0::DOUBLE) - ({b} + {c}) * ln(2)))) END)"""


PAIR = "pair AS MATERIALIZED (SELECT a.subject, a.cohort, a.y AS a, b.y AS b, a.score AS sa, b.score AS sb FROM verdicts a JOIN verdicts b ON a.subject = b.subject AND a.tier = 1996 AND b.tier = 1997)"
CELLS = "count(*) FILTER (a = 1 AND b = 1) AS both_, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither"


def _pair(spark, d):
    return st.paired(views.verdicts(spark, d), "tier", 1996, 1997, extra=["cohort"])


@query("t31_mcnemar", k.q(V, PAIR, f"c AS (SELECT cohort, {CELLS} FROM pair GROUP BY cohort)", body=f"SELECT cohort, only_a, only_b, {k.r4(mcnemar_sql('only_a', 'only_b'))} AS p FROM c"))
def t31(spark, d):
    c = _pair(spark, d).groupBy("cohort").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    return c.withColumn("p", r4(mcnemar(F.col("only_a"), F.col("only_b"))))


@query("t32_holm", k.q(V, PAIR, f"c AS (SELECT cohort, {CELLS} FROM pair GROUP BY cohort), p AS (SELECT cohort, {mcnemar_sql('only_a', 'only_b')} AS p FROM c), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, cohort) + 1) * p AS s FROM p)",
    body=f"SELECT cohort, {k.r4('least(max(s) OVER (ORDER BY p, cohort ROWS UNBOUNDED PRECEDING), 1)')} AS holm FROM s"))
def t32(spark, d):
    c = t31(spark, d).select("cohort", "only_a", "only_b")
    c = c.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))
    return st.holm(c, "p", row_id="cohort").select("cohort", r4("holm").alias("holm"))


@query("t33_reconstruct_2x2", k.q(V, PAIR, f"c AS (SELECT cohort, {CELLS} FROM pair GROUP BY cohort)", body=f"SELECT cohort, both_ AS both, only_a AS lost, only_b AS gained, neither, {k.r4(mcnemar_sql('only_a', 'only_b'))} AS p FROM c"))
def t33(spark, d):
    m = _pair(spark, d).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(F.col("a") == F.col("b")).alias("n_agree"))
    return st.reconstruct_2x2(m).select("cohort", "both", "lost", "gained", "neither", r4("p").alias("p"))


@query("t34_concordance", k.q(V, PAIR, f"c AS (SELECT coalesce(cohort, 'pooled') AS cohort, {CELLS}, count(*)::DOUBLE AS n FROM pair GROUP BY ROLLUP (cohort))", body=f"""
SELECT cohort, both_ AS both, only_a, only_b, neither, {k.r4('(both_ + neither) / n', 6)} AS agreement, {k.r4('both_ / (both_ + only_a + only_b)::DOUBLE', 6)} AS positive_agreement,
  {k.r4('((both_ + neither) / n - ((both_+only_a)/n*((both_+only_b)/n) + (only_b+neither)/n*((only_a+neither)/n))) / (1 - ((both_+only_a)/n*((both_+only_b)/n) + (only_b+neither)/n*((only_a+neither)/n)))', 6)} AS kappa,
  {k.r4(mcnemar_sql('only_a', 'only_b'))} AS p, {k.r4('(both_ + only_a) / n', 6)} AS rate_a, {k.r4('(both_ + only_b) / n', 6)} AS rate_b FROM c"""))
def t34(spark, d):
    t = st.concordance(_pair(spark, d))
    six = ("agreement", "positive_agreement", "kappa", "rate_a", "rate_b")
    return t.select("cohort", "both", "only_a", "only_b", "neither", *[r4(c, 6).alias(c) for c in six], r4("p").alias("p"))


@query("t34_agree_count", k.q(V, PAIR, "c AS (SELECT cohort, count(*) FILTER (a = b) AS agree, count(*) AS n FROM pair GROUP BY cohort)", body="SELECT cohort, n, agree FROM c"))
def t34c(spark, d):
    c = _pair(spark, d).groupBy("cohort").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("f"), F.count(F.lit(1)).alias("n"))
    return c.select("cohort", "n", st.agree_count(F.col("f"), F.col("n")).alias("agree"))


ONE = "base AS MATERIALIZED (SELECT * FROM verdicts WHERE tier = 1996)"
RHO = """
rk AS (SELECT cohort, tier, y, row_number() OVER (PARTITION BY cohort, tier ORDER BY score, subject) AS ra, row_number() OVER (PARTITION BY cohort, tier ORDER BY y, subject) AS rb FROM verdicts),
rho AS MATERIALIZED (SELECT cohort, tier, corr(ra, rb) AS rho, avg(y) AS rate, count(*) AS n FROM rk GROUP BY cohort, tier)"""


@query("t35_spearman", k.q(V, RHO, body=f"SELECT cohort, tier, {k.r4('rho', 6)} AS rho, n FROM rho"))
def t35(spark, d):
    v = views.verdicts(spark, d)
    return st.spearman(v, ["cohort", "tier"], "score", "y", "subject").select("cohort", "tier", r4("rho", 6).alias("rho"), "n")


@query("t36_calibration_gate", k.q(V, RHO, body=f"SELECT cohort, tier, {k.r4('rho', 6)} AS rho, {k.r4('rate', 6)} AS rate, rate BETWEEN 0.10 AND 0.40 AND rho > 0 AS gate FROM rho"))
def t36(spark, d):
    v = views.verdicts(spark, d)
    return st.calibration_gate(v, ["cohort", "tier"], "y", "score", "subject").select("cohort", "tier", r4("rho", 6).alias("rho"), r4("rate", 6).alias("rate"), "gate")


@query("t37_arm_summary", k.q(V, body=f"""
SELECT tier, count(*) AS n, sum(y)::BIGINT AS positives, {k.r4('avg(y)', 6)} AS rate, {k.r4('avg(score)', 6)} AS mean_score, {k.r4('avg(cov)', 6)} AS mean_cov FROM verdicts GROUP BY tier"""))
def t37(spark, d):
    a = st.arm_summary(views.verdicts(spark, d), ["tier"], "y", ["score", "cov"])
    return a.select("tier", "n", "positives", r4("rate", 6).alias("rate"), r4("mean_score", 6).alias("mean_score"), r4("mean_cov", 6).alias("mean_cov"))


@query("t38_design", k.q(V, body="SELECT DISTINCT c.c_custkey AS subject, t.tier FROM customer c CROSS JOIN (SELECT DISTINCT tier FROM verdicts) t"))
def t38(spark, d):
    arms = views.verdicts(spark, d).select("tier").distinct()
    return st.design(arms, views.table(spark, d, "customer").select(F.col("c_custkey").alias("subject")))


@query("t39_factorial", k.q(V, f"""
w AS (SELECT subject, max(y) FILTER (tier = {YEARS[0]}) AS a, max(y) FILTER (tier = {YEARS[1]}) AS b, max(y) FILTER (tier = {YEARS[2]}) AS c, max(y) FILTER (tier = {YEARS[3]}) AS d FROM verdicts GROUP BY subject),
s AS (SELECT count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(d) AS sd, count(*) FILTER (a = 1 AND b = 1) AS kb, count(*) FILTER (a = 0 AND d = 1) AS gd FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL)""",
    body=f"""SELECT n, {k.r4('((sb-sa)+(sd-sc))/2')} AS effect_1, {k.r4('((sc-sa)+(sd-sb))/2')} AS effect_2, CAST((sd-sc)-(sb-sa) AS BIGINT) AS interaction, kb AS kept_B, gd AS gained_D, {k.r4('(sd/n - sa/n) / (0.5 - sa/n)')} AS gap_closed FROM s"""))
def t39(spark, d):
    f = st.factorial(views.verdicts(spark, d), "tier", YEARS)
    return f.select("n", r4("effect_1").alias("effect_1"), r4("effect_2").alias("effect_2"), "interaction", "kept_B", "gained_D", r4("gap_closed").alias("gap_closed"))


@query("t40_tier_agreement", k.q(V, body=f"""
SELECT a.tier, b.tier AS next, {k.r4('avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END)', 6)} AS agreement, count(*) AS n FROM verdicts a JOIN verdicts b ON a.subject = b.subject AND b.tier = a.tier + 1 GROUP BY ALL"""))
def t40(spark, d):
    return st.tier_agreement(cut(views.verdicts(spark, d)))[1].withColumn("agreement", r4("agreement", 6))


@query("t40_tier_consistency", k.q(V, "p AS (SELECT subject, count(*) AS k, min(y) = max(y) AS same FROM verdicts GROUP BY subject), r AS (SELECT tier, avg(y) AS rate FROM verdicts GROUP BY tier ORDER BY tier DESC LIMIT 3)", body="""
SELECT count(*) FILTER (k >= 3 AND same) AS consistent, count(*) FILTER (k >= 3) AS complete, (SELECT max(rate) - min(rate) < 0.10 FROM r) AS settled FROM p"""))
def t40c(spark, d):
    return st.tier_agreement(cut(views.verdicts(spark, d)))[2]


@query("t41_setting_sensitivity", k.q(V, "f AS (SELECT subject, y AS fin FROM verdicts WHERE tier = (SELECT max(tier) FROM verdicts))", body=f"""
SELECT tier, count(*) AS n, {k.r4('avg(y)', 6)} AS rate, {k.r4('count(*) FILTER (y = fin) / greatest(count(fin), 1)', 6)} AS agreement FROM verdicts LEFT JOIN f USING (subject) GROUP BY tier"""))
def t41(spark, d):
    t = st.setting_sensitivity(cut(views.verdicts(spark, d)), "tier", 1999)[0]
    return t.select("tier", "n", r4("rate", 6).alias("rate"), r4("agreement", 6).alias("agreement"))


@query("t41_convergence_flags", k.q(V, "f AS (SELECT subject, y AS fin FROM verdicts WHERE tier = (SELECT max(tier) FROM verdicts)), t AS (SELECT tier, avg(y) AS rate, count(*) FILTER (y = fin) / greatest(count(fin), 1) AS ag FROM verdicts LEFT JOIN f USING (subject) GROUP BY tier)", body=f"""
SELECT {k.r4('max(rate) - min(rate)', 6)} AS spread, max(rate) - min(rate) <= 0.10 AS stable, {k.r4('max(rate) FILTER (tier >= 1999) - min(rate) FILTER (tier >= 1999)', 6)} AS refined_spread,
  count(*) FILTER (tier >= 1999) >= 2 AND max(rate) FILTER (tier >= 1999) - min(rate) FILTER (tier >= 1999) <= 0.05 AND min(ag) FILTER (tier >= 1999) >= 0.95 AS converged FROM t"""))
def t41f(spark, d):
    t = st.setting_sensitivity(cut(views.verdicts(spark, d)), "tier", 1999)[1]
    return t.select(r4("spread", 6).alias("spread"), "stable", r4("refined_spread", 6).alias("refined_spread"), "converged")


@query("t42_paired_change", k.q(V, PAIR, body=f"""
SELECT count(*) AS n, count(*) FILTER (sa <> sb) AS n_changed, {k.r4('max(abs(sa - sb))', 6)} AS max_change, {k.r4('median(abs(sa - sb))', 6)} AS median_change FROM pair"""))
def t42(spark, d):
    p = st.paired(views.verdicts(spark, d), "tier", 1996, 1997, y="score")
    return st.paired_change(p).select("n", "n_changed", r4("max_change", 6).alias("max_change"), r4("median_change", 6).alias("median_change"))


@query("t43_dispersion", k.q(V, body=f"""
SELECT cohort, count(*) AS n, {k.r4('median(score)', 6)} AS median, {k.r4('quantile_cont(score, 0.25)', 6)} AS q25, {k.r4('quantile_cont(score, 0.75)', 6)} AS q75, {k.r4('min(score)', 6)} AS min, {k.r4('max(score)', 6)} AS max, min(score) > 1000 AS all_exceed FROM verdicts GROUP BY cohort"""))
def t43(spark, d):
    t = st.dispersion(views.verdicts(spark, d), ["cohort"], "score", 1000.0)
    return t.select("cohort", "n", *[r4(c, 6).alias(c) for c in ("median", "q25", "q75", "min", "max")], "all_exceed")


@query("t44_n_required", k.q(S, delong_sql("scored", "lang", "low", "tokens", "digit_share"), "c AS (SELECT lang, count(*) AS n FROM scored GROUP BY lang)", body=f"""
SELECT lang, n, {k.r4('n * (2.8016 / abs(z))**2', 0)} AS n80, {k.r4('n * (3.2415 / abs(z))**2', 0)} AS n90 FROM dl JOIN c USING (lang)"""))
def t44(spark, d):
    s = cut(views.scored(spark, d))
    t = st.delong(s, ["lang"], "low", "tokens", "digit_share").join(s.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")
    return t.select("lang", "n", r4(st.n_required(F.col("n"), F.col("z"), "80"), 0).alias("n80"), r4(st.n_required(F.col("n"), F.col("z"), "90"), 0).alias("n90"))


SIMS = 4000
_MA, _MB = st.separation(0.80), st.separation(0.70)


@query("t45_power_grid", k.q(S, f"""
cells AS (SELECT lang || '/' || r AS cell, n1, n0, r FROM (SELECT lang, sum(low)::BIGINT AS n1, (count(*) - sum(low))::BIGINT AS n0 FROM scored GROUP BY lang) CROSS JOIN (SELECT unnest([3, 7]) AS r)),
raw AS MATERIALIZED (SELECT cell, sim, i, r / 10.0::DOUBLE AS r, CASE WHEN i < n1 THEN 1 ELSE 0 END AS y FROM cells CROSS JOIN (SELECT unnest(range({SIMS})) AS sim) CROSS JOIN LATERAL (SELECT unnest(range(n1 + n0)) AS i)),
sim AS MATERIALIZED (SELECT cell, sim, y, {_MA!r}::DOUBLE * y + sqrt(r) * {k.normal(77, 'cell', 'sim', 'i', "'z'")} + sqrt(1 - r) * {k.normal(77, 'cell', 'sim', 'i', "'p'")} AS a,
  {_MB!r}::DOUBLE * y + sqrt(r) * {k.normal(77, 'cell', 'sim', 'i', "'z'")} + sqrt(1 - r) * {k.normal(77, 'cell', 'sim', 'i', "'q'")} AS b FROM raw)""",
    delong_sql("sim", "cell, sim", "y", "a", "b"), body=f"SELECT cell, {k.r4('avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)')} AS power, count(*) AS sims FROM dl GROUP BY cell"))
def t45(spark, d):
    """Power of a .10 AUC gain at each language's own class sizes and two correlations."""
    c = views.scored(spark, d).groupBy("lang").agg(F.sum("low").alias("n1"), (F.count(F.lit(1)) - F.sum("low")).alias("n0"))
    c = c.withColumn("k", F.explode(F.array(F.lit(3), F.lit(7))))
    c = c.select(F.concat_ws("/", "lang", F.col("k").cast("string")).alias("cell"), "n1", "n0", F.lit(_MA).alias("mu_a"), F.lit(_MB).alias("mu_b"), (F.col("k") / 10).alias("r"))
    return st.power_grid(cut(c), SIMS, 77).select("cell", r4("power").alias("power"), "sims")


SIZE_SIMS, SIZE_LO, SIZE_HI = 800, 40, 4000


@query("t45_required_n")
def t45n(spark, d):
    """Size needed for a gain of .10 at the observed share of low-quality documents; SQL is too slow for it, the tests try every size."""
    rate = views.scored(spark, d).agg(F.avg(F.col("low").cast("double")).alias("event_rate"))
    t = rate.select(F.lit("delta10").alias("cell"), F.lit(0.10).alias("delta"), F.lit(0.5).alias("r"), "event_rate")
    return st.required_n(t, SIZE_SIMS, 5, lo=SIZE_LO, hi=SIZE_HI)


@query("t55_elementary_effects", k.q(V, """
t AS (SELECT subject, tier, cohort, cnt::DOUBLE AS x, score AS y FROM verdicts),
e AS (SELECT cohort, (y - lag(y) OVER w) / nullif(x - lag(x) OVER w, 0) AS ee FROM t WINDOW w AS (PARTITION BY subject ORDER BY tier))""", body=f"""
SELECT cohort AS factor, {k.r4('avg(abs(ee))', 4)} AS mu_star, {k.r4('avg(ee)', 4)} AS mu, {k.r4('stddev_pop(ee)', 4)} AS sigma, count(*) AS n FROM e WHERE ee IS NOT NULL GROUP BY cohort"""))
def t55(spark, d):
    """A customer's years are a trajectory; the moved factor is the order count within a segment."""
    v = views.verdicts(spark, d).select(F.col("subject").alias("trajectory"), F.col("tier").alias("step"), F.col("cohort").alias("factor"), F.col("cnt").cast("double").alias("x"), F.col("score").alias("y"))
    e = st.elementary_effects(v)
    return e.select("factor", *[r4(c, 4).alias(c) for c in ("mu_star", "mu", "sigma")], "n")


@query("t56_untraced_numbers", k.q("""
vals AS (SELECT DISTINCT n_chars AS v FROM documents),
known AS (SELECT CAST(v AS VARCHAR) AS lit FROM vals UNION SELECT CAST(v * 100 AS VARCHAR) FROM vals
  UNION SELECT unnest(regexp_extract_all(props, '\\d+(?:\\.\\d+)?')) FROM events UNION SELECT coalesce(nullif(ltrim(x, '0'), ''), '0') FROM (SELECT unnest(regexp_extract_all(props, '\\d+(?:\\.\\d+)?')) AS x FROM events)),
claims AS (SELECT source, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS lit FROM documents)""", body="SELECT source, lit, count(*) AS cnt FROM claims WHERE lit NOT IN (SELECT lit FROM known) GROUP BY ALL"))
def t56(spark, d):
    """Numbers in document text that neither a document length nor an event property explains."""
    doc = views.table(spark, d, "documents")
    ev = views.table(spark, d, "events").select(F.col("props").alias("text")).distinct()
    known = st.traced_numbers(doc.select(F.col("n_chars").cast("double").alias("value")).distinct(), ev)
    return st.untraced_numbers(doc.select("source", "text"), known)
