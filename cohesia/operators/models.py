"""Leak-controlled prediction: folds, keyed penalised logistic regression, boosted trees, linear redundancy.

Every comparison (fold, penalty, column set, noise draw, parameter value, ...) is a value of the
key columns, so one Newton pass over the data advances all fits at once. A pass is one partially
aggregated Gram sum per fit; only p x p sums of each fit reach the driver, as in any linear model.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..plans.lineage import cut
from ..plans.ordered import row_numbers
from .statistics import auc, delong, delta_auc_boot

C_GRID = (0.03, 0.1, 0.3, 1.0, 3.0)

# ---- features --------------------------------------------------------------------------------


def long_features(wide: DataFrame, prefix: str, key: str = "graph_id") -> DataFrame:
    """(graph_id, name, value) rows with a namespace prefix."""
    cols = [c for c in wide.columns if c != key]
    out = wide.select(key, *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in cols])
    return out.unpivot(key, [f"{prefix}{c}" for c in cols], "name", "value")


def design_matrix(features: DataFrame, labels: DataFrame, key: str = "graph_id") -> DataFrame:
    """Wide rows with sorted feature columns, 0 for missing, y and group; unmatched subjects raise."""
    extra = features.select(key).distinct().join(labels, key, "left_anti").limit(1).count()
    missing = labels.select(key).join(features, key, "left_anti").limit(1).count()
    if extra or missing:
        raise ValueError("features and labels do not describe the same subjects")
    names = sorted(r[0] for r in features.select("name").distinct().collect())  # column names of the matrix
    wide = features.groupBy(key).pivot("name", names).agg(F.first("value")).na.fill(0.0)
    return wide.join(labels.withColumn("y", F.col("y").cast("int")), key)


def feature_sets(columns: Sequence[str], prefixes: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Column lists by prefix, e.g. {'full': ('fibhet_', 'conn_'), 'fib': ('fibhet_',)}."""
    return {name: [c for c in columns if c.startswith(tuple(p))] for name, p in prefixes.items()}


# ---- folds -----------------------------------------------------------------------------------


def group_folds(df: DataFrame, group: str, k: int, keys: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """Fold per row so that no group spans two folds: groups ranked by size deal out round-robin."""
    keys = list(keys)
    sizes = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__s"))
    ranked = row_numbers(sizes, keys, [F.col("__s").desc(), F.col(group)], "__r")
    total = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__g"))
    ranked = ranked.join(total, keys) if keys else ranked.crossJoin(total)
    n = F.greatest(F.least(F.lit(k), F.col("__g")), F.lit(2))
    return df.join(ranked.select(*keys, group, (F.col("__r") % n).cast("int").alias(name)), [*keys, group])


def shuffled_folds(df: DataFrame, row_id: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold per row, ignoring groups: rows ranked by a hashed draw deal out round-robin."""
    drawn = df.select(row_id).withColumn("__u", uniform(seed, row_id))
    ranked = row_numbers(drawn, [], [F.col("__u"), F.col(row_id)], "__r")
    return df.join(ranked.select(row_id, (F.col("__r") % k).cast("int").alias(name)), row_id)


# ---- keyed logistic regression -----------------------------------------------------------------


def fit_logistic(train: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str], penalty: str | float = 1.0, tol: float = 1e-9, rounds: int = 40) -> DataFrame:
    """Coefficients per key: columns mean, scale, w (arrays), intercept, prior, one_class.

    Minimises C * log-loss + (|w|^2 + b^2) / 2 on standardised columns (population sd, 1 for a
    constant), by Newton steps shared across all fits. `penalty` is C or the column holding it.
    """
    keys, p = list(keys), len(cols)
    c = F.col(penalty) if isinstance(penalty, str) else F.lit(float(penalty))
    st = train.groupBy(*keys).agg(
        F.array(*[F.avg(x) for x in cols]).alias("mean"), F.array(*[F.stddev_pop(x) for x in cols]).alias("sd"),
        F.avg(F.col(y).cast("double")).alias("prior"), F.max(c).alias("__c"),
    )
    st = st.withColumn("scale", F.transform("sd", lambda s: F.when(s > 1e-12, s).otherwise(F.lit(1.0))))
    st = cut(st.select(*keys, "mean", "scale", "prior", "__c", ((F.col("prior") <= 0) | (F.col("prior") >= 1)).alias("one_class")))
    # One row per fit: the number of fits is set by the experiment, not by the data.
    info = {tuple(r[k] for k in keys): r for r in st.select(*keys, "__c", "one_class").collect()}
    two = F.broadcast(st.where("not one_class"))
    z = [((F.col(x) - F.col("mean")[i]) / F.col("scale")[i]).alias(f"z{i}") for i, x in enumerate(cols)]
    data = train.select(*keys, F.col(y).cast("double").alias("t"), *cols).join(two, keys).select(*keys, "t", *z, F.lit(1.0).alias(f"z{p}")).persist()
    live = {k: np.zeros(p + 1) for k, r in info.items() if not r["one_class"]}
    done: dict = {}
    tri = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    fields = ", ".join(f"`{k}` {t}" for k, t in ((f.name, f.dataType.simpleString()) for f in train.select(*keys).schema))
    spark = train.sparkSession
    try:
        for _ in range(rounds):
            if not live:
                break
            w = spark.createDataFrame([(*k, v.tolist()) for k, v in live.items()], f"{fields}, w array<double>")
            j = data.join(F.broadcast(w), keys)
            eta = reduce(lambda s, t: s + t, [F.col(f"z{i}") * F.col("w")[i] for i in range(p + 1)])
            j = j.withColumn("mu", 1 / (1 + F.exp(-eta)))
            s, e = F.col("mu") * (1 - F.col("mu")), F.col("mu") - F.col("t")
            sums = j.groupBy(*keys).agg(
                *[F.sum(e * F.col(f"z{i}")).alias(f"g{i}") for i in range(p + 1)], *[F.sum(s * F.col(f"z{a}") * F.col(f"z{b}")).alias(f"h{a}_{b}") for a, b in tri]
            )
            for r in sums.collect():
                k = tuple(r[x] for x in keys)
                cc, wv = info[k]["__c"], live[k]
                g = cc * np.array([r[f"g{i}"] for i in range(p + 1)]) + wv
                h = np.eye(p + 1)
                for a, b in tri:
                    h[a, b] += cc * r[f"h{a}_{b}"]
                    if a != b:
                        h[b, a] = h[a, b]
                step = np.linalg.solve(h, g)
                size = np.abs(step).max()
                live[k] = wv - step * min(1.0, 5.0 / max(size, 1e-300))
                if size < tol:
                    done[k] = live.pop(k)
        if live:
            raise RuntimeError("logistic fits did not converge")
    finally:
        data.unpersist()
    coef = spark.createDataFrame([(*k, [float(x) for x in v[:p]], float(v[p])) for k, v in done.items()], f"{fields}, w array<double>, intercept double")
    return st.join(F.broadcast(coef), keys, "left").drop("__c")


def predict_logistic(rows: DataFrame, model: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "prob") -> DataFrame:
    """Probability per row; the training prior where the training set had one class."""
    j = rows.join(F.broadcast(model), list(keys))
    terms = [(F.col(x) - F.col("mean")[i]) / F.col("scale")[i] * F.col("w")[i] for i, x in enumerate(cols)]
    prob = 1 / (1 + F.exp(-(reduce(lambda s, t: s + t, terms) + F.col("intercept"))))
    return j.withColumn(name, F.when(F.col("one_class"), F.col("prior")).otherwise(prob)).drop("mean", "scale", "w", "intercept", "prior", "one_class")


def _train_rows(df: DataFrame, fold: str, name: str) -> DataFrame:
    """Each row once per fold it trains (all folds but its own)."""
    ks = sorted(r[0] for r in df.select(fold).distinct().collect())  # the fold numbers
    return df.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias(name)).where(F.col(fold) != F.col(name))


def oof_logistic(df: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str], fold: str = "fold", penalty: float = 1.0, name: str = "prob") -> DataFrame:
    """Out-of-fold probabilities; rows without a fold get the mean of y of their key."""
    keys = list(keys)
    df = df.persist()
    model = cut(fit_logistic(_train_rows(df.where(F.col(fold).isNotNull()), fold, "__k"), [*keys, "__k"], y, cols, penalty))
    out = predict_logistic(df.where(F.col(fold).isNotNull()).withColumn("__k", F.col(fold)), model, [*keys, "__k"], cols, name).drop("__k")
    rest = df.where(F.col(fold).isNull())
    mean = df.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias(name)) if keys else df.agg(F.avg(F.col(y).cast("double")).alias(name))
    rest = rest.join(mean, keys) if keys else rest.crossJoin(mean)
    out = cut(out.unionByName(rest.select(*out.columns)))
    df.unpersist()
    return out


def oof_logistic_nested(df: DataFrame, y: str, cols: Sequence[str], group: str, fold: str = "fold", grid: Sequence[float] = C_GRID, name: str = "prob") -> tuple[DataFrame, DataFrame]:
    """(out-of-fold probabilities, chosen C per fold): C by pooled inner AUC over up to three inner group folds."""
    df = cut(df)
    tr = cut(group_folds(_train_rows(df, fold, "outer"), group, 3, ["outer"], "inner"))
    cs = F.explode(F.array(*[F.lit(float(c)) for c in grid])).alias("C")
    inner = _train_rows(tr, "inner", "__i").select("*", cs)
    model = cut(fit_logistic(inner, ["outer", "__i", "C"], y, cols, "C"))
    scored = predict_logistic(tr.select("*", cs).withColumn("__i", F.col("inner")), model, ["outer", "__i", "C"], cols, "__score")
    a = auc(cut(scored), ["outer", "C"], y, "__score")
    best = a.groupBy("outer").agg(F.max_by("C", F.struct(F.coalesce("auc", F.lit(-1.0)), -F.col("C"))).alias("C"), F.max("auc").alias("inner_auc"))
    best = cut(best.select("outer", F.when(F.col("inner_auc").isNull(), F.lit(1.0)).otherwise(F.col("C")).alias("C")))
    final = cut(fit_logistic(tr.join(F.broadcast(best), "outer"), ["outer"], y, cols, "C"))
    out = predict_logistic(df.withColumn("outer", F.col(fold)), final, ["outer"], cols, name).drop("outer")
    return out, best


def oof_boosted(df: DataFrame, y: str, cols: Sequence[str], fold: str = "fold", trees: int = 120, seed: int = 0, name: str = "prob") -> DataFrame:
    """Out-of-fold probabilities of shallow boosted trees (depth 2, rate .05, subsample .8), one fit per fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vec = cut(VectorAssembler(inputCols=list(cols), outputCol="__x").transform(df).withColumn("__y", F.col(y).cast("double")))

    def one(k):
        train, test = vec.where(F.col(fold) != k), vec.where(F.col(fold) == k)
        prior = train.agg(F.avg("__y")).first()[0]
        if prior in (0.0, 1.0):
            return test.withColumn(name, F.lit(prior)).drop("__x", "__y")
        m = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=seed).fit(train)
        return m.transform(test).withColumn(name, vector_to_array("probability")[1]).drop("__x", "__y", "rawPrediction", "probability", "prediction")

    folds = [r[0] for r in vec.select(fold).distinct().collect()]  # a handful, set by the caller
    with ThreadPoolExecutor(len(folds) or 1) as pool:  # the fits' jobs run side by side
        return reduce(DataFrame.union, pool.map(one, folds))


# ---- evaluation --------------------------------------------------------------------------------


def both_schemes(df: DataFrame, row_id: str, group: str, k: int, seed: int) -> DataFrame:
    """Rows twice: scheme 'grouped' with group folds and 'naive' with shuffled folds."""
    g = group_folds(df, group, k).withColumn("scheme", F.lit("grouped"))
    return g.unionByName(shuffled_folds(df, row_id, k, seed).withColumn("scheme", F.lit("naive")))


def grouped_vs_naive(df: DataFrame, row_id: str, y: str, cols: Sequence[str], group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """AUC under group folds and under shuffled folds, and their gap."""
    p = oof_logistic(cut(both_schemes(df, row_id, group, k, seed)), ["scheme"], y, cols)
    a = auc(p, ["scheme"], y, "prob")
    one = lambda s: F.max(F.when(F.col("scheme") == s, F.col("auc")))
    return a.agg(one("grouped").alias("auc_grouped"), one("naive").alias("auc_naive")).withColumn("leak", F.col("auc_naive") - F.col("auc_grouped"))


def masked(df: DataFrame, sets: dict[str, Sequence[str]], cols: Sequence[str], key: str = "variant") -> DataFrame:
    """Rows once per column set; columns outside the set are zero, which a standardised fit ignores."""
    names = F.explode(F.array(*[F.lit(s) for s in sets])).alias(key)
    out = df.select("*", names)
    for c in cols:
        inside = [s for s, own in sets.items() if c in own]
        out = out.withColumn(c, F.when(F.col(key).isin(inside), F.col(c)).otherwise(F.lit(0.0)))
    return out


def evaluate_pair(df: DataFrame, row_id: str, y: str, base: Sequence[str], extra: Sequence[str], group: str, k: int = 5, seed: int = 0, draws: int = 200, trees: int | None = None, gate: float = 0.05) -> DataFrame:
    """Base columns against base + extra: AUCs under both schemes, paired test, bootstrap and the gate, one row per classifier."""
    rows = cut(both_schemes(df, row_id, group, k, seed))
    cols = [*base, *extra]
    sets = {"base": list(base), "full": cols}
    p = oof_logistic(masked(rows, sets, cols), ["scheme", "variant"], y, cols)
    wide = p.groupBy("scheme", row_id, y).agg(*[F.max(F.when(F.col("variant") == v, F.col("prob"))).alias(f"p_{v}") for v in sets])
    blocks = [wide.withColumn("clf", F.lit("lr"))]
    if trees:
        for scheme in ("grouped", "naive"):
            part = rows.where(F.col("scheme") == scheme)
            a = oof_boosted(part, y, base, trees=trees, seed=seed, name="p_base").select("scheme", row_id, y, "p_base")
            b = oof_boosted(part, y, cols, trees=trees, seed=seed, name="p_full").select("scheme", row_id, "p_full")
            blocks.append(a.join(b, ["scheme", row_id]).withColumn("clf", F.lit("gbt")))
    allp = cut(reduce(DataFrame.unionByName, blocks))
    d = delong(allp, ["clf", "scheme"], y, "p_full", "p_base")
    g = d.where("scheme = 'grouped'").select("clf", F.col("auc_b").alias("auc_base"), F.col("auc_a").alias("auc_full"), "delta", "z", "p")
    n = d.where("scheme = 'naive'").select("clf", F.col("delta").alias("naive_delta"))
    boots = []
    for clf in ["lr", "gbt"] if trees else ["lr"]:
        part = allp.where((F.col("clf") == clf) & (F.col("scheme") == "grouped"))
        boots.append(delta_auc_boot(part, row_id, y, "p_full", "p_base", draws, seed).withColumn("clf", F.lit(clf)))
    b = reduce(DataFrame.unionByName, boots).select("clf", F.col("mean").alias("boot_mean"), F.col("lo").alias("boot_lo"), F.col("hi").alias("boot_hi"), "p_le_0")
    return g.join(n, "clf").join(b, "clf").withColumn("gate", (F.col("delta") >= gate) & (F.col("p") < 0.05))


def compare_variants(df: DataFrame, row_id: str, y: str, bases: dict[str, Sequence[str]], addons: dict[str, Sequence[str]], group: str, cohort: str | None = None, k: int = 5, min_class: int = 2) -> DataFrame:
    """Every add-on against every base set, per cohort and pooled, fitted and tested in one keyed pass."""
    if cohort is None:
        rows = df.withColumn("cohort", F.lit("combined"))
    else:
        rows = df.select("*", F.explode(F.array(F.col(cohort).cast("string"), F.lit("combined"))).alias("__c")).drop(cohort).withColumnRenamed("__c", "cohort")
    ok = rows.groupBy("cohort").agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) != 1).alias("b")).where((F.col("a") >= min_class) & (F.col("b") >= min_class))
    rows = cut(group_folds(cut(rows.join(ok.select("cohort"), "cohort")), group, k, ["cohort"]))
    cols = sorted({c for s in (*bases.values(), *addons.values()) for c in s})
    sets = {f"{b}|": list(own) for b, own in bases.items()} | {f"{b}|{a}": [*own, *add] for b, own in bases.items() for a, add in addons.items()}
    p = oof_logistic(masked(rows, sets, cols, "set"), ["cohort", "set"], y, cols)
    p = p.select("cohort", row_id, y, "prob", F.split("set", r"\|")[0].alias("base"), F.split("set", r"\|")[1].alias("addon"))
    b = p.where("addon = ''").select("cohort", row_id, "base", F.col("prob").alias("p_base"))
    j = cut(p.where("addon <> ''").join(b, ["cohort", row_id, "base"]))
    return delong(j, ["cohort", "base", "addon"], y, "prob", "p_base").select("cohort", "base", "addon", F.col("auc_b").alias("auc_base"), F.col("auc_a").alias("auc_full"), "delta", "z", "p")


def dry_run(df: DataFrame, row_id: str, y: str, cols: Sequence[str], perms: int = 3, seed: int = 0, limit: float = 0.75, fold: str = "fold") -> DataFrame:
    """AUC of the whole procedure on shuffled labels; `abort` flags a procedure that still predicts."""
    reps = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("perm"))
    a = row_numbers(reps.select("perm", row_id), ["perm"], [F.col(row_id)], "__i")
    b = row_numbers(reps.select("perm", row_id, y).withColumn("__u", uniform(seed, "perm", row_id)), ["perm"], [F.col("__u"), F.col(row_id)], "__i")
    lab = a.join(b.select("perm", "__i", F.col(y).alias("__y")), ["perm", "__i"]).drop("__i")
    p = oof_logistic(cut(reps.join(lab, ["perm", row_id])), ["perm"], "__y", cols, fold)
    return auc(p, ["perm"], "__y", "prob").select("perm", "auc", (F.col("auc") > limit).alias("abort"))


def noise_control(df: DataFrame, row_id: str, y: str, base: Sequence[str], width: int, observed: float, draws: int = 20, seed: int = 1000, fold: str = "fold") -> DataFrame:
    """AUC gain of `width` Gaussian columns, `draws` times, against an observed gain; empirical p = (hits+1)/(draws+1)."""
    cols = [f"noise_{i}" for i in range(width)]
    reps = df.select("*", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"))
    for i, c in enumerate(cols):
        reps = reps.withColumn(c, F.when(F.col("draw") >= 0, normal(seed, "draw", row_id, F.lit(i))).otherwise(F.lit(0.0)))
    p = oof_logistic(cut(reps), ["draw"], y, [*base, *cols], fold)
    a = cut(auc(p, ["draw"], y, "prob"))
    b = a.where("draw = -1").select(F.col("auc").alias("base_auc"))
    d = a.where("draw >= 0").crossJoin(b).withColumn("d", F.col("auc") - F.col("base_auc"))
    return d.agg(
        F.max("base_auc").alias("base_auc"), F.avg("d").alias("noise_mean"), F.stddev_pop("d").alias("noise_sd"), F.max("d").alias("noise_max"),
        ((F.count_if(F.col("d") >= observed) + 1) / (F.count(F.lit(1)) + 1)).alias("p_noise"),
    )


def fold_diagnostic(df: DataFrame, y: str, cols: Sequence[str], fold: str = "fold") -> DataFrame:
    """Correlation of training prevalence with the mean prediction, and the mean within-fold AUC."""
    p = oof_logistic(df, [], y, cols, fold)
    per = p.groupBy(fold).agg(F.avg("prob").alias("mp"), F.sum(F.col(y)).alias("s"), F.count(F.lit(1)).alias("c"))
    tot = per.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    per = per.crossJoin(tot).withColumn("prev", (F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c")))
    within = auc(p, [fold], y, "prob").agg(F.avg("auc").alias("within_auc"))
    return per.agg(F.corr("prev", "mp").alias("r")).crossJoin(within)


def holdout_eval(df: DataFrame, y: str, cols: Sequence[str], is_test: Column, penalty: float = 1.0) -> DataFrame:
    """One fit on the rows outside a fixed test set, scored on the test set."""
    rows = df.withColumn("one", F.lit(1)).withColumn("__t", is_test)
    m = cut(fit_logistic(rows.where("not __t"), ["one"], y, cols, penalty))
    return auc(predict_logistic(rows.where("__t"), m, ["one"], cols), ["one"], y, "prob").drop("one")


def gate_chain(rows: DataFrame, keys: Sequence[str], best_reference: float = 0.80, best_sd: float = 0.04, gate: float = 0.10, alpha: float = 0.05) -> DataFrame:
    """Verdict per key from one row a classifier (delta, p, baseline_auc, p_noise): stop at the first check that fails.

    The gate fires if any classifier's gain reaches it and its test rejects; the baseline is degraded if even
    the best one is two deviations below the reference; noise explains the gain if its p exceeds alpha.
    """
    above = F.col("delta") >= gate
    t = rows.groupBy(*keys).agg(
        F.max(above & (F.col("p") < alpha)).alias("gate_fired"), (F.max("baseline_auc") < F.lit(best_reference - 2 * best_sd)).alias("degraded"),
        (F.max("p_noise") > alpha).alias("noise_explains"), F.max(above).alias("_above"),
    )
    fired, degraded, noisy = F.col("gate_fired"), F.col("degraded"), F.col("noise_explains")
    met = fired & ~degraded & ~noisy
    verdict = (
        F.when(met, "met").when(fired & degraded, "not met: degraded baseline").when(fired, "not met: noise explains")
        .when(F.col("_above"), "inconclusive: test does not reject").otherwise("inconclusive: underpowered")
    )
    return t.withColumns({"endpoint_met": met, "verdict": verdict, "next_stage": F.when(met, "eligible").otherwise("not tested")}).drop("_above")


def replicate_families(df: DataFrame, row_id: str, copies: int, cols: Sequence[str], jitter: float, seed: int) -> DataFrame:
    """Near-copies of every row (relative Gaussian jitter) sharing the source row as their group."""
    r = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    for i, c in enumerate(cols):
        r = r.withColumn(c, F.col(c) * (1 + F.lit(jitter) * normal(seed, row_id, "copy", F.lit(i))))
    return r.withColumn("family", F.col(row_id)).withColumn("row_id", F.col(row_id) * copies + F.col("copy"))


def matched_first(df: DataFrame, cohort: str, row_id: str, n: int) -> DataFrame:
    """The first n rows of each cohort in id order."""
    return row_numbers(df, [cohort], [F.col(row_id)], "__i").where(F.col("__i") < n).drop("__i")


def ladder(df: DataFrame, row_id: str, sizes: Sequence[int]) -> DataFrame:
    """Rows once per rung N they belong to (the first N rows); rungs beyond the data are skipped."""
    r = row_numbers(df, [], [F.col(row_id)], "__i")
    n = df.count()
    rungs = [s for s in sizes if s <= n]
    if not rungs:
        return r.withColumn("rung", F.lit(None).cast("int")).where(F.lit(False)).drop("__i")
    rung = F.explode(F.filter(F.array(*[F.lit(int(s)) for s in rungs]), lambda s: s > F.col("__i"))).alias("rung")
    return r.select("*", rung).drop("__i")


# ---- linear redundancy -------------------------------------------------------------------------


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, centred cross-products and count in one aggregated row."""
    tri = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in tri]).first()
    s = np.zeros((len(cols), len(cols)))
    for i, j in tri:
        s[i, j] = s[j, i] = r[f"c{i}_{j}"]
    return np.array([r[f"m{i}"] for i in range(len(cols))]), s * r["n"], r["n"]


def _r2(s: np.ndarray, y: int, block: list[int]) -> float | None:
    if s[y, y] <= 0:
        return None
    beta = np.linalg.pinv(s[np.ix_(block, block)], rcond=1e-12, hermitian=True) @ s[block, y]
    return float(np.clip(beta @ s[block, y] / s[y, y], 0.0, 1.0))


def r2(df: DataFrame, y: str, block: Sequence[str]) -> DataFrame:
    _, s, _ = gram(df, [y, *block])
    return df.sparkSession.createDataFrame([(y, _r2(s, 0, list(range(1, len(block) + 1))))], "name string, r2 double")


def canon_corr(df: DataFrame, a: Sequence[str], b: Sequence[str], rank_cut: float = 1e-10) -> DataFrame:
    """Leading canonical correlation of two column blocks from their covariance blocks."""
    _, s, _ = gram(df, [*a, *b])
    na = len(a)

    def whiten(m):
        val, vec = np.linalg.eigh(m)
        keep = val > val.max() * rank_cut**2
        return vec[:, keep] / np.sqrt(val[keep])

    c = np.linalg.svd(whiten(s[:na, :na]).T @ s[:na, na:] @ whiten(s[na:, na:]), compute_uv=False)
    return df.sparkSession.createDataFrame([(float(np.clip(c[0], 0.0, 1.0)),)], "canon_corr double")


def redundancy(df: DataFrame, row_id: str, targets: Sequence[str], blocks: dict[str, Sequence[str]], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(R2 of each target on each block and on row-permuted blocks, summary per block)."""
    others = sorted({c for b in blocks.values() for c in b})
    a = row_numbers(df, [], [F.col(row_id)], "__i")
    b = row_numbers(df.select(row_id, *others).withColumn("__u", uniform(seed, row_id)), [], [F.col("__u"), F.col(row_id)], "__i")
    j = a.join(b.select("__i", *[F.col(c).alias(f"perm_{c}") for c in others]), "__i")
    cols = [*targets, *others, *[f"perm_{c}" for c in others]]
    _, s, _ = gram(j, cols)
    rows = []
    for t in targets:
        for name, own in blocks.items():
            plain = _r2(s, cols.index(t), [cols.index(c) for c in own if c != t])
            perm = _r2(s, cols.index(t), [cols.index(f"perm_{c}") for c in own])
            rows.append((t, name, plain, perm))
    long = df.sparkSession.createDataFrame(rows, "name string, block string, r2 double, r2_permuted double")
    s2 = long.groupBy("block").agg(F.median("r2").alias("median_r2"), F.median("r2_permuted").alias("median_permuted"), F.count_if(F.col("r2") >= 0.60).alias("n_redundant"), F.count_if(F.col("r2") < 0.25).alias("n_independent"))
    return long, s2
