"""Exact rank statistics, resampling and paired-design tables, all keyed so many comparisons run at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import normal, normal_runs, uniform
from ..functions.tails import mcnemar, normal_quantile, normal_tail, two_sided_p
from ..plans.lineage import cut, tasks, width
from ..plans.ordered import midranks, quantiles, row_numbers

# ---- ranks and ROC ---------------------------------------------------------------------------


def midrank(df: DataFrame, keys: Sequence[str], value: str, name: str = "midrank", group_rows=None) -> DataFrame:
    """Average rank over ties, 1-based, on every row."""
    tied = midranks(df, keys, value, {"__c": F.lit(1)}, group_rows)
    tied = tied.select(*keys, value, (F.col("__c_below") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(tied, [*keys, value])


def auc(df: DataFrame, keys: Sequence[str], y: str, score: str, weight: Column | None = None, name: str = "auc", group_rows=None) -> DataFrame:
    """Area under the ROC curve per key (ties count half); NULL when a class is missing."""
    w = F.lit(1) if weight is None else weight
    pos, neg = F.when(F.col(y) == 1, w).otherwise(F.lit(0)), F.when(F.col(y) == 1, F.lit(0)).otherwise(w)
    t = midranks(df, keys, score, {"__p": pos, "__n": neg}, group_rows)
    s = t.groupBy(*keys).agg(
        F.sum(F.col("__p") * (F.col("__n_below") + F.col("__n") / 2)).alias("__u"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg")
    )
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return s.select(*keys, F.when(ok, F.col("__u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias(name), "n_pos", "n_neg")


def _placements(df: DataFrame, keys, y: str, score: str, name: str, group_rows) -> DataFrame:
    """Share of the other class below a score (ties half), per distinct score."""
    pos = F.when(F.col(y) == 1, F.lit(1)).otherwise(F.lit(0))
    t = midranks(df, keys, score, {"__p": pos, "__n": 1 - pos}, group_rows)
    return t.select(*keys, score, (F.col("__n_below") + F.col("__n") / 2).alias(f"{name}_n"), (F.col("__p_below") + F.col("__p") / 2).alias(f"{name}_p"))


def delong(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str, group_rows=None) -> DataFrame:
    """Paired DeLong test per key: auc_a, auc_b, delta, z, p. NULL where a class is missing."""
    keys = list(keys)
    if a == b:
        df, b = df.withColumn("__b", F.col(a)), "__b"
    rows = cut(df.select(*keys, y, a, b))  # read several times below
    j = rows.join(_placements(rows, keys, y, a, "a", group_rows), [*keys, a]).join(_placements(rows, keys, y, b, "b", group_rows), [*keys, b])
    size = rows.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("m"), F.count_if(F.col(y) != 1).alias("n"))
    j = j.join(size, keys) if keys else j.crossJoin(size)
    pos = F.col(y) == 1
    va = F.when(pos, F.col("a_n") / F.col("n")).otherwise(1 - F.col("a_p") / F.col("m"))
    vb = F.when(pos, F.col("b_n") / F.col("n")).otherwise(1 - F.col("b_p") / F.col("m"))
    d = va - vb
    s = j.groupBy(*keys).agg(
        F.avg(F.when(pos, va)).alias("auc_a"), F.avg(F.when(pos, vb)).alias("auc_b"),
        F.coalesce(F.var_samp(F.when(pos, d)), F.lit(0.0)).alias("s1"), F.coalesce(F.var_samp(F.when(~pos, d)), F.lit(0.0)).alias("s0"),
        F.max("m").alias("m"), F.max("n").alias("n"),
    )
    ok = (F.col("m") > 0) & (F.col("n") > 0)
    var = F.col("s1") / F.col("m") + F.col("s0") / F.col("n")
    delta = F.col("auc_a") - F.col("auc_b")
    z = F.when(ok, F.when(var > 0, delta / F.sqrt(var)).otherwise(F.lit(0.0)))
    out = s.select(*keys, F.when(ok, F.col("auc_a")).alias("auc_a"), F.when(ok, F.col("auc_b")).alias("auc_b"), F.when(ok, delta).alias("delta"), z.alias("z"), F.when(ok, var).alias("var"))
    return out.withColumn("p", F.when(F.col("var") > 0, two_sided_p(F.col("z"))).when(F.col("z").isNotNull(), F.lit(1.0)))


# ---- bootstrap -------------------------------------------------------------------------------


def stratified_resample(df: DataFrame, row_id: str, y: str, draws: int, seed: int) -> DataFrame:
    """(replicate, row columns, times): each replicate redraws every class at its own size.

    Draws are counted per (replicate, row) before they meet the data, so the join and all later
    ranking see each chosen row once.
    """
    base = cut(row_numbers(df, [y], [F.col(row_id)], "__i"))
    size = base.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
    return _redraw(base, size, [y], draws, lambda: uniform(seed, "replicate", F.col(y).cast("int"), "slot"))


def _redraw(base: DataFrame, size: DataFrame, keys: Sequence[str], draws: int, at) -> DataFrame:
    """(replicate, row columns, times) of base(keys, __i, ...), redrawn within keys at their own size(keys, __n).

    Slots are dealt over enough tasks before each becomes `draws` rows, and so are the chosen rows.
    """
    wide = tasks(base.sparkSession, base.count() * draws)
    slots = base.select(*keys, F.col("__i").alias("slot")).join(size, list(keys)).repartition(wide, *keys, "slot")
    picks = slots.select(*keys, "slot", "__n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("replicate"))
    pick = F.least(F.floor(at() * F.col("__n")), F.col("__n") - 1).cast("long")
    picks = picks.select(*keys, "replicate", pick.alias("__i")).repartition(wide, *keys, "__i")
    counts = picks.groupBy(*keys, "__i", "replicate").agg(F.count(F.lit(1)).alias("times"))
    return counts.join(base, [*keys, "__i"]).drop("__i")


def auc_ci(df: DataFrame, row_id: str, y: str, score: str, draws: int, seed: int) -> DataFrame:
    """Point AUC, 2.5/97.5 percentiles and standard error over stratified replicates."""
    n = df.count()
    s = stratified_resample(df.select(row_id, y, score), row_id, y, draws, seed)
    reps = cut(auc(s, ["replicate"], y, score, F.col("times"), group_rows=n).withColumn("one", F.lit(1)))
    ci = quantiles(reps, ["one"], "auc", {"lo": 0.025, "hi": 0.975}, group_rows=draws)
    se = reps.groupBy("one").agg(F.stddev_samp("auc").alias("se"), F.count("auc").alias("n_valid"))
    point = auc(df, [], y, score).select("auc")
    return ci.join(se, "one").drop("one").crossJoin(point)


def delta_auc_boot(df: DataFrame, row_id: str, y: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Mean, interval, P(delta <= 0) and valid count of AUC(a) - AUC(b) on shared replicates."""
    n = df.count()
    s = cut(stratified_resample(df.select(row_id, y, a, b), row_id, y, draws, seed))
    one = lambda c, name: auc(s, ["replicate"], y, c, F.col("times"), name, group_rows=n).select("replicate", name)
    d = cut(one(a, "u").join(one(b, "v"), "replicate").select((F.col("u") - F.col("v")).alias("d"), F.lit(1).alias("one")))
    ci = quantiles(d, ["one"], "d", {"lo": 0.025, "hi": 0.975}, group_rows=draws)
    m = d.groupBy("one").agg(F.avg("d").alias("mean"), F.avg((F.col("d") <= 0).cast("double")).alias("p_le_0"), F.count("d").alias("n_valid"))
    return m.join(ci, "one").drop("one")


def median_boot(df: DataFrame, keys: Sequence[str], row_id: str, value: str, draws: int, seed: int) -> DataFrame:
    """2.5/97.5 percentiles of the resampled median per key."""
    keys = list(keys)
    base = cut(row_numbers(df.select(*keys, row_id, value), keys, [F.col(row_id)], "__i"))
    size = cut(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    chosen = _redraw(base, size, keys, draws, lambda: uniform(seed, *keys, "replicate", "slot"))
    most = size.agg(F.max("__n")).first()[0] or 0
    med = cut(quantiles(chosen, [*keys, "replicate"], value, {"med": 0.5}, group_rows=most, weight="times"))
    return quantiles(med, keys, "med", {"lo": 0.025, "hi": 0.975}, group_rows=draws)


# ---- calibration -----------------------------------------------------------------------------


def calibration(df: DataFrame, keys: Sequence[str], y: str, prob: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per-bin table, per-key Brier and ECE). Bins compare against the edges, so p = edge goes right."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.least(F.size(F.filter(edges, lambda e: e <= F.col(prob))), F.lit(bins - 1))
    gap = F.col(prob) - F.col(y)
    t = df.groupBy(*keys, b.alias("bin")).agg(F.avg(prob).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("cnt"), F.sum(gap * gap).alias("sq"))
    s = t.groupBy(*keys).agg((F.sum("sq") / F.sum("cnt")).alias("brier"), (F.sum(F.col("cnt") * F.abs(F.col("rate") - F.col("mean_pred"))) / F.sum("cnt")).alias("ece"))
    return t.drop("sq"), s


# ---- rank tests ------------------------------------------------------------------------------


EXACT_RANKS = 50  # the signed-rank null is enumerated up to this many differences


def _signed_rank_tail(ties: Column, w_plus: Column, n: Column) -> Column:
    """P(W+ <= w_plus) when every sign is a fair coin; ties(r: twice the midrank, c: how often) are one group's ranks.

    The chances of all sums of doubled ranks are built up rank by rank, so ties need no approximation.
    """
    ranks = F.flatten(F.transform(ties, lambda t: F.array_repeat(t["r"], t["c"].cast("int"))))
    sums = F.sequence(F.lit(0), (n * (n + 1)).cast("int"))
    start = F.transform(sums, lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def add(chance, r):
        return F.transform(chance, lambda c, x: c / 2 + F.when(x >= r, F.get(chance, x - r)).otherwise(F.lit(0.0)) / 2)

    below = F.slice(F.aggregate(ranks, start, add), F.lit(1), (2 * w_plus + 1).cast("int"))
    return F.least(F.aggregate(below, F.lit(0.0), lambda acc, c: acc + c), F.lit(1.0))


def wilcoxon_less(df: DataFrame, keys: Sequence[str], value: str, centre: float = 0.5) -> DataFrame:
    """One-sided signed-rank test that values sit below `centre`: n, W+, z and p.

    Differences of zero are left out. p is exact up to EXACT_RANKS differences, ties included, and the
    tie-corrected normal one beyond; z is NULL where the variance is zero. A group without differences has no row.
    """
    keys = list(keys)
    d = df.withColumn("__d", F.col(value) - F.lit(centre)).where("__d <> 0").withColumn("__a", F.abs("__d"))
    up = F.when(F.col("__d") > 0, 1).otherwise(0)
    t = midranks(d, keys, "__a", {"__c": F.lit(1), "__u": up})
    rank = F.col("__c_below") + (F.col("__c") + 1) / 2
    c = F.col("__c").cast("double")
    # At most EXACT_RANKS entries a group; complete where they are used.
    low = F.when(F.col("__c_below") < EXACT_RANKS, F.struct((2 * rank).cast("int").alias("r"), F.col("__c").alias("c")))
    s = t.groupBy(*keys).agg(F.sum(F.col("__u") * rank).alias("w_plus"), F.sum("__c").alias("n"), F.sum(c * c * c - c).alias("tie"), F.collect_list(low).alias("low"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)
    p = F.when(F.col("n") <= EXACT_RANKS, _signed_rank_tail(F.col("low"), F.col("w_plus"), F.col("n"))).otherwise(1 - normal_tail(z))
    return s.select(*keys, "n", "w_plus", F.when(var > 0, z).alias("z"), p.alias("p"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, row_id: str) -> DataFrame:
    """Correlation of ordinal ranks, ties broken by id; NULL for fewer than 3 rows or a constant column."""
    keys = list(keys)
    ra = row_numbers(df.select(*keys, row_id, a, b), keys, [F.col(a), F.col(row_id)], "__ra")
    rb = row_numbers(ra, keys, [F.col(b), F.col(row_id)], "__rb")
    s = rb.groupBy(*keys).agg(
        F.corr("__ra", "__rb").alias("rho"), F.count(F.lit(1)).alias("n"), (F.min(a) < F.max(a)).alias("va"), (F.min(b) < F.max(b)).alias("vb")
    )
    return s.select(*keys, F.when((F.col("n") >= 3) & F.col("va") & F.col("vb"), F.col("rho")).alias("rho"), "n")


def calibration_gate(df: DataFrame, keys: Sequence[str], y: str, cov: str, row_id: str, lo=0.10, hi=0.40) -> DataFrame:
    rate = df.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("rate"))
    j = spearman(df, keys, cov, y, row_id).join(rate, list(keys))
    return j.withColumn("gate", F.col("rate").between(lo, hi) & F.coalesce(F.col("rho") > 0, F.lit(False)))


# ---- paired designs --------------------------------------------------------------------------


def paired(df: DataFrame, arm: str, first, second, y: str = "y", subject: str = "subject", extra: Sequence[str] = ()) -> DataFrame:
    """One row per subject present in both arms, as columns a and b."""
    a = df.where(F.col(arm) == F.lit(first)).select(subject, *extra, F.col(y).alias("a"))
    b = df.where(F.col(arm) == F.lit(second)).select(subject, F.col(y).alias("b"))
    return a.join(b, subject)


def concordance(pairs: DataFrame, cohort: str = "cohort") -> DataFrame:
    """2x2 agreement per cohort plus the pooled row, from columns a and b in {0,1}."""
    t = pairs.rollup(cohort).agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"),
    )
    return agreement(t.withColumn(cohort, F.coalesce(cohort, F.lit("pooled"))))


def agreement(t: DataFrame) -> DataFrame:
    """Agreement, positive agreement, Cohen kappa, exact McNemar p and marginal rates from 2x2 counts."""
    a, b, c, d = (F.col(x).cast("double") for x in ("both", "only_a", "only_b", "neither"))
    n = a + b + c + d
    po = (a + d) / n
    pe = (a + b) / n * ((a + c) / n) + (c + d) / n * ((b + d) / n)
    return t.withColumns({
        "agreement": po, "positive_agreement": F.when(a + b + c > 0, a / (a + b + c)), "kappa": F.when(F.abs(1 - pe) >= 1e-12, (po - pe) / (1 - pe)),
        "p": mcnemar(F.col("only_a"), F.col("only_b")), "rate_a": (a + b) / n, "rate_b": (a + c) / n,
    })


def agree_count(fraction: Column, n: Column) -> Column:
    """Count behind a stored agreement fraction."""
    return F.bround(fraction * n, 0).cast("long")


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), row_id: str = "id") -> DataFrame:
    """Step-down adjusted p: running maximum of (m - rank + 1) p, capped at 1. One family is a short list."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy(p, row_id)
    step = (F.count(F.lit(1)).over(part) - F.row_number().over(w) + 1) * F.col(p)
    s = df.withColumn("__s", step)
    return s.withColumn("holm", F.least(F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__s")


def reconstruct_2x2(df: DataFrame) -> DataFrame:
    """2x2 cells from (n, n_a, n_b, n_agree); impossible inputs raise."""
    disc = F.col("n") - F.col("n_agree")
    tb, tc = F.col("n_a") - F.col("n_b") + disc, F.col("n_b") - F.col("n_a") + disc
    b, c = F.floor(tb / 2), F.floor(tc / 2)
    a = F.col("n_a") - b
    d = F.col("n_agree") - a
    ok = (tb % 2 == 0) & (tc % 2 == 0) & (F.least(a, b, c, d) >= 0) & (a + b + c + d == F.col("n"))
    checked = F.when(ok, b).otherwise(F.raise_error(F.lit("2x2 table is not integral or has a negative cell")).cast("long"))
    return df.withColumns({"lost": checked, "gained": c, "both": a, "neither": d}).withColumn("p", mcnemar(F.col("lost"), F.col("gained")))


def arm_summary(df: DataFrame, arm: Sequence[str], y: str, covariates: Sequence[str]) -> DataFrame:
    return df.groupBy(*arm).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).cast("long").alias("positives"), F.avg(F.col(y).cast("double")).alias("rate"), *[F.avg(c).alias(f"mean_{c}") for c in covariates])


def design(arms: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every arm for every subject: each subject row carries the short arm list and is exploded."""
    fields = arms.agg(F.collect_list(F.struct(*arms.columns)).alias("__arms"))
    return subjects.crossJoin(F.broadcast(fields)).select(*subjects.columns, F.explode("__arms").alias("__a")).select(*subjects.columns, "__a.*")


def factorial(df: DataFrame, arm: str, arms: Sequence, subject: str = "subject", y: str = "y", target_rate: float = 0.5) -> DataFrame:
    """2x2 factorial of four arms (A baseline, B, C, D both) on subjects present in all of them."""
    wide = df.where(F.col(arm).isin(list(arms))).groupBy(subject).agg(*[F.max(F.when(F.col(arm) == F.lit(v), F.col(y))).alias(c) for c, v in zip("ABCD", arms)])
    wide = wide.dropna(subset=list("ABCD"))
    s = wide.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in "ABCD"],
        *[F.count_if((F.col("A") == 1) & (F.col(c) == 1)).alias(f"kept_{c}") for c in "BCD"],
        *[F.count_if((F.col("A") == 0) & (F.col(c) == 1)).alias(f"gained_{c}") for c in "BCD"],
    )
    A, B, C, D = (F.col(c) for c in "ABCD")
    ra, rd = A / F.col("n"), D / F.col("n")
    return s.withColumns({"effect_1": ((B - A) + (D - C)) / 2, "effect_2": ((C - A) + (D - B)) / 2, "interaction": (D - C) - (B - A), "gap_closed": (rd - ra) / (F.lit(target_rate) - ra)})


def tier_agreement(df: DataFrame, subject: str = "subject", tier: str = "tier", y: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rate per tier, agreement of consecutive tiers, one summary row)."""
    rate = df.groupBy(tier).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(tier)  # one row per tier
    nxt = rate.select(tier, F.lead(tier).over(w).alias("next")).where("next is not null")
    a = df.select(subject, F.col(tier), F.col(y).alias("ya")).join(F.broadcast(nxt), tier)
    b = df.select(subject, F.col(tier).alias("next"), F.col(y).alias("yb"))
    pair = a.join(b, [subject, "next"]).groupBy(tier, "next").agg(F.avg((F.col("ya") == F.col("yb")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("k"), (F.min(y) == F.max(y)).alias("same"))
    cons = per.agg(F.count_if((F.col("k") >= 3) & F.col("same")).alias("consistent"), F.count_if(F.col("k") >= 3).alias("complete"))
    last = rate.withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(tier).desc()))).where("__r <= 3")
    settled = last.agg((F.max("rate") - F.min("rate") < 0.10).alias("settled"))
    return rate, pair, cons.crossJoin(settled)


def setting_sensitivity(df: DataFrame, setting: str, refined_from, subject: str = "subject", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(per-setting rate and agreement with the finest, one row of stability flags)."""
    top = df.agg(F.max(setting).alias("__top"))
    best = df.join(F.broadcast(top), F.col(setting) == F.col("__top")).select(subject, F.col(y).alias("fin"))
    j = df.join(best, subject, "left")
    t = j.groupBy(setting).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"),
        (F.count_if(F.col(y) == F.col("fin")) / F.greatest(F.count("fin"), F.lit(1))).alias("agreement"),
    )
    ref = F.col(setting) >= F.lit(refined_from)
    s = t.agg(
        (F.max("rate") - F.min("rate")).alias("spread"), F.count_if(ref).alias("k"),
        (F.max(F.when(ref, F.col("rate"))) - F.min(F.when(ref, F.col("rate")))).alias("refined_spread"), F.min(F.when(ref, F.col("agreement"))).alias("worst"),
    )
    return t, s.select("spread", (F.col("spread") <= 0.10).alias("stable"), "refined_spread", ((F.col("k") >= 2) & (F.col("refined_spread") <= 0.05) & (F.col("worst") >= 0.95)).alias("converged"))


def paired_change(pairs: DataFrame) -> DataFrame:
    """Count changed, largest and median absolute change of columns a, b."""
    d = cut(pairs.select(F.abs(F.col("a") - F.col("b")).alias("d"), F.lit(1).alias("one")))
    m = quantiles(d, ["one"], "d", {"median_change": 0.5})
    return d.groupBy("one").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_changed"), F.max("d").alias("max_change")).join(m, "one").drop("one")


def dispersion(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    q = quantiles(df, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    s = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    return s.join(q, list(keys)).withColumn("all_exceed", F.col("min") > limit)


# Normal quantile sums for a two-sided 5% test at 80% and 90% power; fixed values.
POWER_Z = {"80": 2.8016, "90": 3.2415}


def n_required(n: Column, z: Column, level: str = "80") -> Column:
    """Sample size at which the observed effect reaches the power level; infinity for a null effect."""
    return F.when(F.abs(z) < 1e-12, F.lit(float("inf"))).otherwise(n * F.pow(F.lit(POWER_Z[level]) / F.abs(z), F.lit(2.0)))


# ---- simulated power -------------------------------------------------------------------------


def _scores(y: Column, r: str, seed: int, *keys) -> list[Column]:
    """Columns a and b of one simulated subject, with r of the variance shared."""
    shared, own = F.sqrt(r) * normal(seed, *keys, F.lit("z")), F.sqrt(1 - F.col(r))
    return [(F.col(f"mu_{c}") * y + shared + own * normal(seed, *keys, F.lit(k))).alias(c) for c, k in (("a", "p"), ("b", "q"))]


def separation(auc_value: float) -> float:
    """Binormal mean shift giving an AUC with unit variances."""
    return 2.0**0.5 * normal_quantile(auc_value)


def _placed(pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the other class below each positive and above each negative, ties half."""
    by = [np.argsort(x) for x in (pos, neg)]
    p, n = pos[by[0]], neg[by[1]]

    def share(x, other, at):
        out = np.empty(len(x))
        out[at] = (np.searchsorted(other, x, "left") + np.searchsorted(other, x, "right")) / (2 * len(other))
        return out

    return share(p, n, by[0]), 1 - share(n, p, by[1])


def _paired_moments(pos: pd.Series, neg: pd.Series) -> pd.DataFrame:
    """Mean difference of the two AUCs and its variance from a, b, a, b, ... of each class."""
    out = []
    spread = lambda x: x.var(ddof=1) / len(x) if len(x) > 1 else 0.0
    for p, n in zip(pos, neg):
        (pa, na), (pb, nb) = _placed(p[0::2], n[0::2]), _placed(p[1::2], n[1::2])
        out.append(((pa - pb).mean(), spread(pa - pb) + spread(na - nb)))
    return pd.DataFrame(out, columns=["delta", "var"])


def _paired_p(pos: Column, neg: Column) -> Column:
    """p of the paired test between the scores a and b of two classes, each an array a, b, a, b, ..."""
    return _moments_p(F.pandas_udf(_paired_moments, "delta double, var double")(pos, neg))


def _moments_p(t: Column) -> Column:
    return F.transform(F.array(t), lambda t: F.when(t["var"] > 0, two_sided_p(t["delta"] / F.sqrt(t["var"]))).otherwise(F.lit(1.0)))[0]


def _simulated_p(seed: int, n1: str, n0: str, own_ids: bool) -> Column:
    """p of the paired test of each simulation (cell, sim, class sizes, shifts, r), drawn within its task, so nothing is shuffled or grouped.

    The draws are those of _scores() with the keys (cell, sim, i), negatives numbered after the positives, or (cell, sim, y, i)
    if each class has its own ids.
    """

    def moments(cell: pd.Series, sim: pd.Series, n1: pd.Series, n0: pd.Series, mu_a: pd.Series, mu_b: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for c, s, n1_, n0_, a, b, share in zip(cell, sim, n1, n0, mu_a, mu_b, r):
            scores = []
            for y, count, start in ((1, n1_, 0), (0, n0_, 0 if own_ids else n1_)):
                prefix = f"{seed}|{c}|{s}|" + (f"{y}|" if own_ids else "")
                z, p, q = normal_runs(prefix, int(start), int(count), "zpq")
                x = np.empty(2 * int(count))
                x[0::2] = a * y + np.sqrt(share) * z + np.sqrt(1 - share) * p
                x[1::2] = b * y + np.sqrt(share) * z + np.sqrt(1 - share) * q
                scores.append(x)
            out.append(_paired_moments([scores[0]], [scores[1]]))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"delta": [], "var": []}, dtype=float)

    return _moments_p(F.pandas_udf(moments, "delta double, var double")("cell", "sim", n1, n0, "mu_a", "mu_b", "r"))


def _simulations(cells: DataFrame, sims: int) -> DataFrame:
    """One row per simulation of each cell, dealt over all tasks."""
    s = cells.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    return s.repartition(4 * width(cells.sparkSession), "sim", "cell", *[c for c in ("size",) if c in cells.columns])


def power_grid(cells: DataFrame, sims: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Share of simulations in which the paired test rejects, per cells(cell, n1, n0, mu_a, mu_b, r); classes of at least one."""
    t = _simulations(cells, sims).select("cell", _simulated_p(seed, "n1", "n0", own_ids=False).alias("p"))
    return t.groupBy("cell").agg(F.avg((F.col("p") < alpha).cast("double")).alias("power"), F.count(F.lit(1)).alias("sims"))


PARTS = 8  # parts that a round of the size search cuts an interval into


def search_rounds(lo: int, hi: int) -> int:
    """Rounds until every interval that can be left is one size wide: the first cuts by ratio, the others evenly."""
    width, rounds = hi + 1 - (hi + 1) * ((lo - 1) / (hi + 1)) ** (1 / PARTS) + 1, 1
    while width > 1:
        width, rounds = math.ceil(width / PARTS), rounds + 1
    return rounds


def required_n(targets: DataFrame, sims: int, seed: int, power: float = 0.80, lo: int = 40, hi: int = 4000, base: float = 0.70, alpha: float = 0.05) -> DataFrame:
    """Smallest size in [lo, hi] reaching `power` per targets(cell, delta, r, event_rate), NULL if none does.

    Subject i of a class is the same in every size of a simulation, so sizes are compared on common draws. All
    cells search together: a round tries PARTS - 1 sizes inside each open interval, power counts as reached from
    the first size that reaches it, and the interval before that size is kept. The number of rounds is fixed by
    lo and hi; nothing returns to the driver. The gain `delta` needs base + delta < 1.
    """
    cells = targets.select("cell", F.col("delta").cast("double").alias("delta"), F.col("r").cast("double").alias("r"), F.col("event_rate").cast("double").alias("rate"))
    # Shifts of the few gains in the table, by the normal quantile; rows of the grid, not data.
    shift = F.pandas_udf(lambda d: d.map(lambda x: separation(base + x)), "double")
    state = cut(cells.select("cell", "r", "rate", shift("delta").alias("mu_a"), F.lit(separation(base)).alias("mu_b"), F.lit(lo - 1).alias("below"), F.lit(hi + 1).alias("at")))
    parts = F.sequence(F.lit(1), F.lit(PARTS - 1))
    for step in range(search_rounds(lo, hi)):
        wide = (F.col("at") - F.col("below")).cast("double")
        if step == 0:
            size = lambda j: F.floor(F.col("below") * F.pow(F.col("at") / F.col("below"), j / PARTS) + 0.5)
        else:
            size = lambda j: F.floor(F.col("below") + wide * j / PARTS + 0.5)
        tried = F.filter(F.array_distinct(F.transform(parts, lambda j: size(j).cast("int"))), lambda x: (x > F.col("below")) & (x < F.col("at")))
        grid = state.select("cell", "r", "rate", "mu_a", "mu_b", F.explode(tried).alias("size"))
        n1 = F.greatest(F.floor(F.col("size") * F.col("rate") + 0.5).cast("int"), F.lit(2))
        grid = grid.withColumn("n1", n1).withColumn("n0", F.greatest(F.col("size") - F.col("n1"), F.lit(2)))
        tests = _simulations(grid, sims).select("cell", "size", _simulated_p(seed, "n1", "n0", own_ids=True).alias("p"))
        seen = tests.groupBy("cell", "size").agg((F.count_if(F.col("p") < alpha) >= power * F.count(F.lit(1))).alias("reached"))
        seen = seen.groupBy("cell").agg(F.min(F.when(F.col("reached"), F.col("size"))).alias("first"), F.collect_list("size").alias("sizes"))  # at most PARTS - 1
        at = F.coalesce("first", "at")
        below = F.coalesce(F.array_max(F.filter("sizes", lambda x: x < at)), F.col("below"))
        state = cut(state.join(seen, "cell", "left").select("cell", "r", "rate", "mu_a", "mu_b", below.alias("below"), at.alias("at")))
    return state.select("cell", F.when(F.col("at") <= hi, F.col("at")).alias("n"))


# ---- misc ------------------------------------------------------------------------------------


def elementary_effects(steps: DataFrame) -> DataFrame:
    """steps(trajectory, step, factor, x, y): effect dy/dx of the factor moved at each step, summarised per factor."""
    w = Window.partitionBy("trajectory").orderBy("step")  # a trajectory has k+1 points
    e = steps.withColumn("ee", (F.col("y") - F.lag("y").over(w)) / F.nullif(F.col("x") - F.lag("x").over(w), F.lit(0.0))).where("ee is not null")
    return e.groupBy("factor").agg(F.avg(F.abs("ee")).alias("mu_star"), F.avg("ee").alias("mu"), F.stddev_pop("ee").alias("sigma"), F.count(F.lit(1)).alias("n"))


def traced_numbers(values: DataFrame, texts: DataFrame) -> DataFrame:
    """Known literals: values(value) at 0-4 decimals, plain and as percentages, and digits inside texts(text)."""
    shown = [F.round(F.col("value") * m, k) for m in (1, 100) for k in range(5)]
    as_text = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    a = values.select(F.explode(F.array(*[as_text(c) for c in shown])).alias("lit"))
    m = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("lit"))
    b = m.select(F.explode(F.array(F.col("lit"), F.coalesce(F.nullif(F.ltrim("lit", F.lit("0")), F.lit("")), F.lit("0")))).alias("lit"))
    return a.union(b).distinct()


def untraced_numbers(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Literals in claims(source, text) that no known literal explains, with their counts."""
    c = claims.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("lit"))
    return c.groupBy("source", "lit").agg(F.count(F.lit(1)).alias("cnt")).join(known, "lit", "left_anti")
