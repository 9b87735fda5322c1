"""Low eigenvalues of many perturbed copies of a graph, from the eigenpairs of the graph itself.

A variant is the list of its changed edges; the edges of the graph are never copied for it. With U the
lowest eigenvectors of the graph and D the Laplacian of a variant's drops, the variant's matrix is
diag(values) - U'DU on the span of U: one product of endpoint differences a changed edge, summed by
variant. On graphs of up to DENSE_LIMIT nodes U is the whole space and this is exact.

On larger graphs the part of DUc outside the span of U, over the changed edges' ends alone, is the
residual. Variants whose residual is too large go on together: block Lanczos on (graph - drops) that
starts from their Ritz vectors, where a product takes the graph's cached matrix, stored once, and the
changed entries that each node carries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import TARGET_ROWS, endpoints
from ..plans.lineage import cut, width
from .spectrum import DENSE_LIMIT, Matrix, by_class, cycles, laplacian, lowest

G = "graph_id"
SUBSPACE = 6  # base pairs of a graph above DENSE_LIMIT nodes
TOL = 1e-7  # residual, relative to the Gershgorin bound
_DELTA = "array<struct<i:bigint,val:double>>"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of drop * d d' over runs of rows (graph, variant, drop, d)."""
    for b in batches:
        if not b.num_rows:
            continue
        names = np.array([f"{g}\0{v}" for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], object)
        edge = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        drop = b.column(2).to_numpy(zero_copy_only=False)
        grams = []
        for a, z in zip(edge, np.append(edge[1:], len(names))):
            d = b.column(3).slice(a, z - a).flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
            grams.append((d.T @ (d * drop[a:z, None])).tobytes())
        take = pa.array(edge)
        yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(grams)], names=[G, "variant", "gram"])


def _reduce(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lam = np.asarray(pdf["lam"].iloc[0])
        m = len(lam)
        h = sum(np.frombuffer(g).reshape(m, m) for g in pdf["gram"])
        val, c = np.linalg.eigh(np.diag(lam) - (h + h.T) / 2)
        q = min(k, m)
        return pd.DataFrame({G: [pdf[G].iloc[0]], "variant": [pdf["variant"].iloc[0]], "vals": [val[:q]], "coef": [c[:, :q].T.ravel()]})

    return solve


def low_values(edges: DataFrame, nodes: DataFrame, drops: DataFrame, k: int = 3, tol: float = TOL, subspace: int = SUBSPACE, dense_limit: int = DENSE_LIMIT, max_rounds: int = 60) -> DataFrame:
    """(graph_id, variant, l1 .. lk, residual) of each variant in drops(graph_id, variant, src, dst, drop).

    A variant's weights are those of the graph less its drops (a negative drop adds weight; a changed edge
    need not be an edge of the graph); its nodes are the graph's. Values that a graph of fewer nodes lacks
    are null. The residual is that of the worst of the k pairs; on graphs of up to `dense_limit` nodes it is 0.
    """
    nodes = cut(nodes.select(G, "node_id").distinct())
    edges = edges.select(G, "src", "dst", "w")
    drops = cut(drops.where("src <> dst").groupBy(G, F.col("variant").cast("string").alias("variant"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("drop").alias("drop")))
    sizes = cut(nodes.groupBy(G).agg((F.count(F.lit(1)) > dense_limit).alias("large")))
    small, large = sizes.agg(F.count_if(~F.col("large")), F.count_if("large")).first()
    parts = []
    for is_large, have in ((False, small), (True, large)):
        if have:
            of = sizes.where(F.col("large") == is_large).select(G)
            own = lambda df: df.join(of, G, "left_semi") if small and large else df  # noqa: B023, E731
            parts.append(_update(own(edges), own(nodes), own(drops), k, tol, subspace if is_large else dense_limit, is_large, max_rounds))
    columns = f"{G} string, variant string, vals array<double>, residual double"
    out = edges.sparkSession.createDataFrame([], columns) if not parts else parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.select(G, "variant", *[F.get("vals", F.lit(i)).alias(f"l{i + 1}") for i in range(k)], "residual")


def _update(edges, nodes, drops, k: int, tol: float, m: int, large: bool, max_rounds: int) -> DataFrame:
    lap = cut(laplacian(edges, nodes))
    pairs = lowest(lap, nodes, max(m, k) if large else m)
    in_order = lambda by, x: F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda s: s[x])
    vec = cut(pairs.groupBy(G, "node_id").agg(in_order("idx", "x").alias("q")))  # at most m numbers a node
    lam = pairs.groupBy(G, "idx").agg(F.max("val").alias("val")).groupBy(G).agg(in_order("idx", "val").alias("lam"))
    # Differences over an edge are formed once, however many variants change it.
    ends = endpoints(drops.select(G, "src", "dst").distinct(), vec, ["q"]).select(G, "src", "dst", F.zip_with("q_s", "q_d", lambda a, b: a - b).alias("d"))
    changed = cut(drops.join(ends, [G, "src", "dst"]).select(G, "variant", "src", "dst", "drop", "d"))
    # Ranges keep a variant's rows together and still spread one that changes very many edges.
    runs = changed.repartitionByRange(max(2, width(edges.sparkSession)), G, "variant", "src", "dst").sortWithinPartitions(G, "variant")
    grams = runs.select(G, "variant", "drop", "d").mapInArrow(_partial, f"{G} string, variant string, gram binary")
    schema = f"{G} string, variant string, vals array<double>, coef array<double>"
    ritz = cut(grams.join(lam, G).groupBy(G, "variant").applyInPandas(_reduce(k), schema))
    if not large:
        return ritz.select(G, "variant", "vals", F.lit(0.0).alias("residual"))

    # Dx at the ends of changed edges, x = Uc: its part outside the span of U is the residual.
    m = max(m, k)
    dot = lambda c, t: F.aggregate(F.zip_with(c, F.slice("coef", t * m + 1, m), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    moved = changed.join(ritz, [G, "variant"]).select(G, "variant", "src", "dst", *[(F.col("drop") * dot("d", t)).alias(f"f{t}") for t in range(k)])
    two = F.explode(F.array(F.struct(F.col("src").alias("node_id"), *[F.col(f"f{t}").alias(f"f{t}") for t in range(k)]), F.struct(F.col("dst").alias("node_id"), *[(-F.col(f"f{t}")).alias(f"f{t}") for t in range(k)])))
    touched = moved.select(G, "variant", two.alias("r")).groupBy(G, "variant", "r.node_id").agg(*[F.sum(f"r.f{t}").alias(f"f{t}") for t in range(k)]).join(vec, [G, "node_id"])
    inside = [F.sum(F.get("q", F.lit(j)) * F.col(f"f{t}")) for t in range(k) for j in range(m)]
    sums = touched.groupBy(G, "variant").agg(*[F.sum(F.col(f"f{t}") * F.col(f"f{t}")).alias(f"all{t}") for t in range(k)], F.array(*inside).alias("in"))
    outside = [F.sqrt(F.greatest(F.col(f"all{t}") - F.aggregate(F.slice("in", t * m + 1, m), F.lit(0.0), lambda s, v: s + v * v), F.lit(0.0))) for t in range(k)]
    bound = lap.groupBy(G, "i").agg(F.sum(F.abs("val")).alias("row")).groupBy(G).agg(F.max("row").alias("size"))
    judged = ritz.join(sums, [G, "variant"]).join(bound, G).select(G, "variant", "vals", "coef", F.greatest(*outside, F.lit(0.0)).alias("residual"), "size")
    judged = cut(judged.withColumn("done", F.col("residual") <= F.lit(tol) * F.col("size")))
    settled = judged.where("done").select(G, "variant", "vals", "residual")
    if not judged.where("not done").limit(1).count():
        return settled

    # The matrix is stored once for each bucket of variants, whose products are then at most about TARGET_ROWS or one variant's.
    open_ = judged.where("not done").select(G, "variant", "coef")
    load = lap.groupBy(G).agg(F.count(F.lit(1)).alias("rows")).join(open_.groupBy(G).agg(F.count(F.lit(1)).alias("variants")), G)
    load = load.select(G, F.least(F.col("variants"), F.ceil(F.col("variants") * F.col("rows") / TARGET_ROWS)).cast("int").alias("buckets"))
    bucket = F.concat_ws("#", G, F.pmod(F.xxhash64("variant"), F.col("buckets")).cast("string"))
    open_ = cut(open_.join(load, G).select(G, "variant", "coef", bucket.alias("base"), F.concat_ws("#", G, "variant").alias("key")))
    p = max(2, k)
    start = vec.join(open_, G).select("base", F.col("key").alias(G), "node_id", F.array(*[dot("q", F.lit(t)) if t < k else F.get("q", F.lit(m - 1)) for t in range(p)]).alias("q"))
    both = F.explode(F.array(*[F.struct(F.col(a).alias("j"), F.col(b).alias("i"), (s * F.col("drop")).alias("val")) for a, b, s in (("src", "dst", 1), ("dst", "src", 1), ("src", "src", -1), ("dst", "dst", -1))]))
    entries = drops.join(open_.select(G, "variant", "base", "key"), [G, "variant"]).select("base", F.col("key").alias(G), both.alias("e"))
    entries = cut(entries.groupBy("base", G, F.col("e.j").alias("node_id"), "e.i").agg(F.sum("e.val").alias("val")))
    shared = lap.join(open_.select(G, "base").distinct(), G).select(F.col("base").alias(G), "i", "j", "val")

    def solve(part: DataFrame, whole: bool) -> list[DataFrame]:
        matrix = Matrix(part, whole, added=entries.join(part.select(F.col(G).alias("base")).distinct(), "base", "left_semi"))
        delta = entries.join(matrix.bound.select(F.col(G).alias("base"), "e"), "base").groupBy(G, "node_id").agg(F.collect_list(F.struct("i", (F.col("val") / F.col("e")).alias("val"))).alias("delta"))
        state = start.join(matrix.bound.select(F.col(G).alias("base")), "base", "left_semi").join(delta, [G, "node_id"], "left")
        return cycles(matrix, k, tol, 7, max_rounds, state.withColumn("delta", F.coalesce("delta", F.array().cast(_DELTA))))

    found = by_class(shared, solve)
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    each = rows.groupBy(G, "idx").agg(F.max("val").alias("val"), F.max("residual").alias("residual"))
    solved = each.groupBy(G).agg(in_order("idx", "val").alias("vals"), F.max("residual").alias("residual"))
    solved = open_.select(G, "variant", "key").join(solved.withColumnRenamed(G, "key"), "key").select(G, "variant", "vals", "residual")
    return cut(settled.union(solved))
