"""Low eigenpairs of every graph's matrix in one job.

Matrices are tables coo(graph_id, i, j, val). Two regimes share one result shape:

* n <= DENSE_LIMIT: the Rayleigh-Ritz basis is the identity, so the m x m reduction of one graph
  (at most DENSE_LIMIT^2 numbers, the bound of every reduction here) is already exact after one
  shuffle. Perturb-and-recompute operators make thousands of such groups, solved side by side.
* larger: thick-restart block Lanczos for all graphs together. A node's state is an array of its
  values in the basis; a step is one join of the stored matrix with the last block and one
  aggregation that appends the next block. A cycle's blocks follow the Chebyshev recurrence over the
  Gershgorin interval, which keeps them independent without inner products on the way; the
  whole basis, kept vectors included, is then orthogonalised through its Gram matrix, reduced by
  Rayleigh-Ritz, and the lowest Ritz vectors with their residuals start the next cycle. Only Gram
  matrices of a graph leave the tables. Graphs leave the loop as they converge.

Graphs of up to TARGET_ROWS entries are dealt by graph, once: steps and cycles then run without any
shuffle. The entries of larger graphs are dealt by column, and hub columns are split over salts.

Unconverged values are never returned silently: every pair carries its residual.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans.joins import TARGET_ROWS
from ..plans.lineage import cut, settings, width

G = "graph_id"
DENSE_LIMIT = 60
BASIS = 60  # basis vectors of a cycle, about
STATEMENT = 6  # steps written as one statement
PAIRS = "graph_id string, node_id long, idx int, val double, residual double, x double"


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions, parallel entries summed, self-loops kept once."""
    both = edges.select(G, "src", "dst", "w").union(edges.where("src <> dst").select(G, "dst", "src", "w"))
    return both.groupBy(G, "src", "dst").agg(F.sum("w").alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(G, F.col("src").alias("node_id")).agg(F.sum("w").alias("deg"))


def laplacian(edges: DataFrame, nodes: DataFrame, kind: str = "comb") -> DataFrame:
    """COO Laplacian: comb D-W, sym I-D^-1/2 W D^-1/2, rw I-D^-1 W; self-loops ignored."""
    if kind not in ("comb", "sym", "rw"):
        raise ValueError(f"unknown Laplacian kind {kind!r}")
    adj = adjacency(edges.where("src <> dst"))
    deg = adj.groupBy(G, F.col("src").alias("i")).agg(F.sum("w").alias("d"))
    base = nodes.select(G, F.col("node_id").alias("i")).join(deg, [G, "i"], "left")
    if kind == "comb":
        diag = base.select(G, "i", F.col("i").alias("j"), F.coalesce("d", F.lit(0.0)).alias("val"))
        return diag.union(adj.select(G, "src", "dst", (-F.col("w")).alias("val")))
    diag = base.select(G, "i", F.col("i").alias("j"), F.lit(1.0).alias("val"))
    off = adj.join(deg.select(G, F.col("i").alias("src"), F.col("d").alias("ds")), [G, "src"])
    if kind == "rw":
        val = F.when(F.col("ds") > 0, -F.col("w") / F.col("ds")).otherwise(F.lit(0.0))
    else:
        off = off.join(deg.select(G, F.col("i").alias("dst"), F.col("d").alias("dd")), [G, "dst"])
        ok = (F.col("ds") > 0) & (F.col("dd") > 0)
        val = F.when(ok, -F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).otherwise(F.lit(0.0))
    return diag.union(off.select(G, "src", "dst", val.alias("val")))


def lap_apply(edges: DataFrame, vec: DataFrame, cols: list[str]) -> DataFrame:
    """(Lx)_i = sum_j w_ij (x_i - x_j) for each vector column, as one aggregation over both edge ends."""
    x = lambda side: vec.select(G, F.col("node_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
    e = edges.where("src <> dst").join(x("src"), [G, "src"]).join(x("dst"), [G, "dst"])
    flow = lambda a, b: [(F.col("w") * (F.col(f"{c}_{a}") - F.col(f"{c}_{b}"))).alias(c) for c in cols]
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), *flow("src", "dst")), F.struct(F.col("dst").alias("node_id"), *flow("dst", "src"))))
    s = e.select(G, ends.alias("r")).groupBy(G, "r.node_id").agg(*[F.sum(f"r.{c}").alias(f"l_{c}") for c in cols])
    out = vec.join(s, [G, "node_id"], "left")
    return out.select(*vec.columns, *[F.coalesce(f"l_{c}", F.lit(0.0)).alias(f"l_{c}") for c in cols])


def _reduce(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"].to_numpy())
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])), pdf["val"])
        val, vec = np.linalg.eigh((m + m.T) / 2)
        q = min(k, len(ids))
        res = np.linalg.norm(m @ vec[:, :q] - vec[:, :q] * val[:q], axis=0)
        rep = lambda v: np.repeat(v, len(ids))
        return pd.DataFrame({
            G: pdf[G].iloc[0], "node_id": np.tile(ids, q), "idx": rep(np.arange(q)), "val": rep(val[:q]), "residual": rep(res), "x": vec[:, :q].T.ravel(),
        })

    return solve


def _dense(coo: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    diag = nodes.select(G, F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.0).alias("val"))
    return coo.select(G, "i", "j", "val").union(diag).groupBy(G).applyInPandas(_reduce(k), PAIRS)


def lowest(coo: DataFrame, nodes: DataFrame, k: int, tol: float = 1e-7, dense_limit: int = DENSE_LIMIT, seed: int = 7, max_rounds: int = 60) -> DataFrame:
    """k algebraically smallest eigenpairs per graph (k clipped to n) as PAIRS rows, checkpointed.

    `tol` bounds the residual relative to the Gershgorin bound. A graph that has not settled after
    `max_rounds` keeps its pairs of the last round, whose residuals tell; the others are not affected.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if dense_limit > DENSE_LIMIT:
        raise ValueError(f"the in-group reduction is limited to {DENSE_LIMIT} nodes")
    nodes = nodes.select(G, "node_id").distinct()
    sizes = cut(nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n")))
    n_small, n_large = sizes.agg(F.count_if(F.col("n") <= dense_limit), F.count_if(F.col("n") > dense_limit)).first()
    parts = []
    if n_small:
        small = sizes.where(F.col("n") <= dense_limit).select(G)
        parts.append(_dense(coo.join(small, G, "left_semi") if n_large else coo, nodes.join(small, G, "left_semi") if n_large else nodes, k))
    if n_large:
        big = sizes.where(F.col("n") > dense_limit).select(G)
        parts += _lanczos(coo.join(big, G, "left_semi"), nodes.join(big, G, "left_semi"), k, tol, seed, max_rounds)
    if not parts:
        return coo.sparkSession.createDataFrame([], PAIRS)
    return cut(reduce(DataFrame.union, parts))


class Matrix:
    """Stored matrix (M - c) / e of graphs of one class, whose spectrum lies in [-1, 1], and (graph_id, c, e, size) as `scale`.

    With `added`(base, graph_id, node_id, i, val), graph_id names a variant of the graph `base`: M plus these entries, of which
    node_id is the column. The matrix is stored once for all variants; a variant's state carries `base` and, as `delta`, the
    added entries of its column.
    """

    def __init__(self, coo: DataFrame, whole_graphs: bool, added: DataFrame | None = None):
        coo = cut(coo)
        self.whole, self.extra = whole_graphs, [] if added is None else ["base", "delta"]
        disc = coo.groupBy(G, "i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("val")).otherwise(0.0)).alias("d"),
                                       F.sum(F.when(F.col("i") != F.col("j"), F.abs("val")).otherwise(0.0)).alias("r"))
        ends = disc.groupBy(G).agg(F.max(F.col("d") + F.col("r")).alias("hi"), F.min(F.col("d") - F.col("r")).alias("lo"))
        if added is not None:  # added weight may lift the upper end; what lowers the lower end only speeds the lowest pairs up
            more = added.where("node_id = i and val > 0").groupBy(F.col("base").alias(G)).agg(F.max("val").alias("more"))
            ends = ends.join(more, G, "left").withColumn("hi", F.col("hi") + 2 * F.coalesce("more", F.lit(0.0)))
        half = F.greatest((F.col("hi") - F.col("lo")) / 2 * F.lit(1 + 1e-9), F.lit(1e-300))
        self.bound = cut(ends.select(G, ((F.col("hi") + F.col("lo")) / 2).alias("c"), half.alias("e"), F.greatest(F.abs("hi"), F.abs("lo")).alias("size")))
        self.scale = self.bound if added is None else cut(added.select("base", G).distinct().join(self.bound.withColumnRenamed(G, "base"), "base").drop("base"))
        coo = coo.join(self.bound, G).select(G, "i", "j", ((F.col("val") - F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)) / F.col("e")).alias("val"))
        load = coo.groupBy(G, "j").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > TARGET_ROWS)
        self.hubs = None if whole_graphs else cut(load.select(G, "j", F.ceil(F.col("rows") / TARGET_ROWS).cast("int").alias("salts")))
        if self.hubs is not None and not self.hubs.limit(1).count():
            self.hubs = None
        self.keys = [G, "j"]
        if self.hubs is not None:
            coo = coo.join(self.hubs, [G, "j"], "left").withColumn("salt", F.pmod(F.xxhash64("i"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
            self.keys = [G, "j", "salt"]
        of = "base" if self.extra else G
        self.deal = [of] if whole_graphs else [of, "node_id"]
        by = [G] if whole_graphs else self.keys
        self.table = cut(coo.repartition(width(coo.sparkSession), *by).sortWithinPartitions(*self.keys))

    def steps(self, state: DataFrame, p: int, count: int) -> DataFrame:
        """The array q grows by `count` blocks of p values after its last one, T_0: M T_0 first, then 2 M T_j - T_(j-1).

        A row's own array travels with its diagonal entry, so the chain is a linear plan. STATEMENT steps are one
        statement, since analysing step by step costs more than small cohorts take to run.
        """
        for j in range(0, count, STATEMENT):
            state = self._statement(state, p, min(STATEMENT, count - j), j == 0)
            if not self.whole:  # each step shuffles: keep plans short and finished work safe
                state = cut(state)
        return state

    def _statement(self, state: DataFrame, p: int, count: int, first_of_all: bool) -> DataFrame:
        own, first = "t.graph_id = s.graph_id AND t.j = s.node_id", "first(if(e.own, s.{0}, null), true) AS {0}"
        entries = "array(struct(t.i AS i, t.val AS val, t.i = t.j AS own))"
        if self.extra:
            own = "t.graph_id = s.base AND t.j = s.node_id"
            entries = f"concat({entries}, if(t.i = t.j, transform(s.delta, x -> struct(x.i AS i, x.val AS val, false AS own)), array()))"
        carried = ["q", *self.extra[1:]]
        parts = []
        for j in range(count):
            prior = f"s{j}" if j else "{state}"
            if self.hubs is not None:
                at_base = "b.base" if self.extra else "b.graph_id"
                prior = f"(SELECT b.*, salt FROM {prior} b LEFT JOIN {{hubs}} h ON h.graph_id = {at_base} AND h.j = b.node_id LATERAL VIEW explode(sequence(0, coalesce(h.salts, 1) - 1)) x AS salt)"
            # Places are counted from the end, so that all steps compile to the same code.
            new = ", ".join(f"2 * n{t} - element_at(q, {t - 2 * p})" if j or not first_of_all else f"n{t}" for t in range(p))
            joined = f"{{table}} t JOIN {prior} s ON {own}" + (" AND t.salt = s.salt" if self.hubs is not None else "")
            if self.extra:
                sums = ", ".join(f"sum(e.val * element_at(s.q, {t - p})) AS n{t}" for t in range(p))
                inner = f"SELECT /*+ MERGE(t) */ s.base, s.graph_id, e.i AS node_id, {', '.join(first.format(c) for c in carried)}, {sums} FROM {joined} LATERAL VIEW inline({entries}) e AS i, val, own GROUP BY s.base, s.graph_id, e.i"
            else:
                sums = ", ".join(f"sum(t.val * element_at(s.q, {t - p})) AS n{t}" for t in range(p))
                inner = f"SELECT /*+ MERGE(t) */ t.graph_id, t.i AS node_id, first(if(t.i = t.j, s.q, null), true) AS q, {sums} FROM {joined} GROUP BY t.graph_id, t.i"
            parts.append(f"s{j + 1} AS (SELECT graph_id, node_id, {''.join(c + ', ' for c in self.extra)}concat(q, array({new})) AS q FROM ({inner}))")
        text = "WITH " + ", ".join(parts) + f" SELECT * FROM s{count}"
        known = {"table": self.table, "state": state} | ({} if self.hubs is None else {"hubs": self.hubs})
        return self.table.sparkSession.sql(text, **known)


def _grams(m: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            edge = np.flatnonzero(np.append(True, names[1:] != names[:-1]))  # runs of a graph
            ends = np.append(edge[1:], len(names))
            gram = [(x[a:z].T @ x[a:z]).tobytes() for a, z in zip(edge, ends)]
            yield pa.record_batch([pa.array(names[edge], pa.string()), pa.array(gram)], names=[G, "gram"])

    return run


def _ritz(kept: int, p: int, steps: int, keep: int):
    """Sum a graph's partial Gram matrices and reduce: Ritz values and the coefficients of Ritz vectors and their images.

    Columns of the Gram matrix: kept vectors U, their images MU, then the blocks T_0 .. T_steps.
    """
    m, total = kept + p * steps, 2 * kept + p * (steps + 1)
    basis, image = np.zeros((total, m)), np.zeros((total, m))
    basis[:kept, :kept] = image[kept : 2 * kept, :kept] = np.eye(kept)
    for j in range(steps):
        own = slice(kept + p * j, kept + p * (j + 1))
        at = lambda b: slice(2 * kept + p * b, 2 * kept + p * (b + 1))
        basis[at(j), own] = np.eye(p)
        for b in (j + 1, abs(j - 1)):  # M T_j is half the sum of its neighbours in the recurrence; M T_0 = T_1
            image[at(b), own] += np.eye(p) / 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(x).reshape(total, total) for x in pdf["gram"])
        b, a = basis.T @ g @ basis, basis.T @ g @ image
        d = np.diag(b)
        scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
        s, u = np.linalg.eigh(b * scale[:, None] * scale)
        good = s > 1e-12 * s[-1]
        q = scale[:, None] * (u[:, good] / np.sqrt(s[good]))
        theta, v = np.linalg.eigh(q.T @ (a + a.T) / 2 @ q)
        c = np.zeros((m, keep))
        have = min(keep, len(theta))
        c[:, :have] = (q @ v)[:, :have]
        theta = np.append(theta[:have], np.zeros(keep - have))
        coef = np.concatenate([basis @ c, image @ c], 1).T.ravel()
        return pd.DataFrame({G: [pdf[G].iloc[0]], "theta": [theta], "coef": [coef]})

    return solve


def _rotate(wide: DataFrame, kept: int, p: int, steps: int, keep: int, extra: list[str]) -> DataFrame:
    """From a cycle's basis to (graph_id, node_id, theta, q): `keep` Ritz vectors, their images, and the first p residuals."""
    total = 2 * kept + p * (steps + 1)
    grams = wide.select(G, "q").mapInArrow(_grams(total), f"{G} string, gram binary")
    ritz = cut(grams.groupBy(G).applyInPandas(_ritz(kept, p, steps, keep), f"{G} string, theta array<double>, coef array<double>"))
    dot = lambda t: F.aggregate(F.zip_with("q", F.slice("coef", t * total + 1, total), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    out = wide.join(ritz, G).select(G, "node_id", *extra, "theta", F.transform(F.sequence(F.lit(0), F.lit(2 * keep - 1)), dot).alias("q"))
    residual = lambda t: F.get("q", t + keep) - F.get("theta", t) * F.get("q", t)
    return out.withColumn("q", F.concat("q", F.transform(F.sequence(F.lit(0), F.lit(p - 1)), residual)))


def _lanczos(coo: DataFrame, nodes: DataFrame, k: int, tol: float, seed: int, max_rounds: int) -> list[DataFrame]:
    diag = nodes.select(G, F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.0).alias("val"))
    coo = cut(coo.select(G, "i", "j", "val").union(diag).groupBy(G, "i", "j").agg(F.sum("val").alias("val")))
    return by_class(coo, lambda part, whole: cycles(Matrix(part, whole), k, tol, seed, max_rounds))


def by_class(coo: DataFrame, solve) -> list[DataFrame]:
    """Results of solve(coo, whole) for the graphs of up to TARGET_ROWS entries, dealt by graph, and for larger ones, dealt by column."""
    spark = coo.sparkSession
    sizes = cut(coo.groupBy(G).agg((F.count(F.lit(1)) <= TARGET_ROWS).alias("whole")))
    out = []
    for whole in (True, False):
        of = sizes.where(F.col("whole") == whole).select(G)
        if of.limit(1).count():
            # Rows dealt by graph are dealt well enough to join by (graph, node); a chain without
            # shuffles has nothing to replan, and without numbers in class names its steps share compiled code.
            with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.useIdInClassName": "false"} if whole else {}):
                out += solve(coo.join(of, G, "left_semi"), whole)
    return out


def cycles(mat: Matrix, k: int, tol: float, seed: int, max_rounds: int, state: DataFrame | None = None) -> list[DataFrame]:
    """Rows of PAIRS in the order in which graphs settle; `state` (with a q of max(2, k) start values a node) replaces the random start."""
    p = max(2, k)
    keep = 4 * p if 8 * p <= BASIS else 2 * p
    steps = max(4, (BASIS - keep) // p)
    if state is None:
        start = [uniform(seed, G, "i", F.lit(t)) - 0.5 for t in range(p)]
        state = mat.table.where("i = j").select(G, F.col("i").alias("node_id"), F.array(*start).alias("q"))
    state = cut(state.repartition(width(state.sparkSession), *mat.deal).sortWithinPartitions(*mat.deal[:1], "node_id"))
    kept, finished = 0, []
    for cycle in range(max_rounds):
        wide = cut(mat.steps(state.drop("theta"), p, steps))
        state = cut(_rotate(wide, kept, p, steps, keep, mat.extra))
        kept = keep
        loss = lambda t: F.sum(F.get("q", F.lit(2 * keep + t)) * F.get("q", F.lit(2 * keep + t)))
        left = state.groupBy(G).agg(F.greatest(*[loss(t) for t in range(k)], F.lit(0.0)).alias("worst")).join(mat.scale, G)
        left = cut(left.select(G, (F.sqrt("worst") * F.col("e") <= F.lit(tol) * F.col("size")).alias("done")))
        ok, live = left.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        last = cycle == max_rounds - 1
        if ok or last:
            finished.append(_finish(mat, state if last else state.join(left.where("done"), G, "left_semi"), k))
        if last or not live:
            return finished
        if ok:
            state = cut(state.join(left.where("not done"), G, "left_semi"))
    raise ValueError("max_rounds must be at least 1")


def _finish(mat: Matrix, state: DataFrame, k: int) -> DataFrame:
    """One more product and reduction of the k lowest vectors alone: orthonormal, with the residuals they really have."""
    low = state.select(G, "node_id", *mat.extra, F.slice("q", 1, k).alias("q"))
    pairs = _rotate(cut(mat.steps(low, k, 1)), 0, k, 1, k, mat.extra)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.struct(t.cast("int").alias("idx"), F.get("theta", t).alias("th"), F.get("q", t).alias("x"), F.get("q", t + 2 * k).alias("r"))))
    rows = cut(pairs.select(G, "node_id", each.alias("v")).select(G, "node_id", "v.*"))
    norm = rows.groupBy(G, "idx").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("r")).join(mat.scale, G).select(G, "idx", (F.col("r") * F.col("e")).alias("residual"), "c", "e")
    return cut(rows.drop("r").join(norm, [G, "idx"]).select(G, "node_id", "idx", (F.col("c") + F.col("e") * F.col("th")).alias("val"), "residual", "x"))


# ---- public pairs ----------------------------------------------------------------------------


def smallest_eigpairs(edges: DataFrame, nodes: DataFrame, k: int, kind: str = "comb", **kw) -> DataFrame:
    if kind == "rw":
        raise ValueError("eigenpairs need a symmetric Laplacian: comb or sym")
    return lowest(laplacian(edges, nodes, kind), nodes, k, **kw)


def eigenvalues(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(G, "idx").agg(F.max("val").alias("val"), F.max("residual").alias("residual"), F.count(F.lit(1)).alias("n"))


def fiedler(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, lambda2, phi); a graph with fewer than two nodes raises."""
    if pairs is None:
        if nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n")).where("n < 2").limit(1).count():
            raise ValueError("fiedler needs at least two nodes in every graph")
        pairs = smallest_eigpairs(edges, nodes, 2)
    return pairs.where("idx = 1").select(G, "node_id", F.col("val").alias("lambda2"), F.col("x").alias("phi"))


def spectral_gap(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """lambda3 - lambda2, 0 when n < 3."""
    pairs = smallest_eigpairs(edges, nodes, 3) if pairs is None else pairs
    v = eigenvalues(pairs).groupBy(G).agg(
        F.max(F.when(F.col("idx") == 2, F.col("val"))).alias("l3"), F.max(F.when(F.col("idx") == 1, F.col("val"))).alias("l2")
    )
    return v.select(G, F.coalesce(F.col("l3") - F.col("l2"), F.lit(0.0)).alias("gap"))


def perron(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, rho, perron): algebraically largest pair of W, signed by its largest entry, clamped at 0."""
    adj = adjacency(edges)
    pairs = lowest(adj.select(G, F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("val")), nodes, 1)
    sign = pairs.groupBy(G).agg(F.signum(F.max_by("x", F.struct(F.abs("x"), -F.col("node_id")))).alias("sg"))
    return pairs.join(sign, G).select(G, "node_id", (-F.col("val")).alias("rho"), F.greatest(F.col("x") * F.col("sg"), F.lit(0.0)).alias("perron"))


def lap_norm(edges: DataFrame, nodes: DataFrame, dw: str = "dw") -> DataFrame:
    """Operator norm of the Laplacian whose weights are `dw`."""
    lap = laplacian(edges.select(G, "src", "dst", F.col(dw).alias("w")), nodes)
    pairs = lowest(lap.withColumn("val", -F.col("val")), nodes, 1)
    return pairs.groupBy(G).agg(F.max(-F.col("val")).alias("norm"))
