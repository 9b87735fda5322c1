"""Triangulated surfaces as tables: nodes(graph_id,node_id,x,y,z,...), faces(graph_id,face_id,a,b,c,tag,vx,vy,vz)."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import cross3, dot3, grid_region, unit3
from ..plans.joins import clip, endpoints, salted
from ..plans.ordered import largest_group, row_numbers
from .components import components

G = "graph_id"
PACKED_ROWS = 4096  # longest list carried inside a row


# ---- shapes ----------------------------------------------------------------------------------


def corners(faces: DataFrame, *keep: str) -> DataFrame:
    """One row per (face, corner)."""
    return faces.select(G, "face_id", *keep, F.posexplode(F.array("a", "b", "c")).alias("corner", "node_id"))


def face_edges(faces: DataFrame, *keep: str) -> DataFrame:
    """Three (src<dst) edges per face, not deduplicated."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst"))
    out = faces.select(G, "face_id", *keep, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e"))
    return out.select(G, "face_id", *keep, "e.src", "e.dst").where("src <> dst")


def mesh_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).select(G, "src", "dst").distinct()


def face_points(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Faces with the coordinates of each corner (ax..cz)."""
    out = faces
    for k in "abc":
        pts = nodes.select(G, F.col("node_id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"])
        out = out.join(pts, [G, k])
    return out


def _vec(p: str, q: str) -> list[Column]:
    return [F.col(f"{q}{c}") - F.col(f"{p}{c}") for c in "xyz"]


def face_normal() -> list[Column]:
    """Cross product of two sides (length = twice the area), over `face_points` columns."""
    return cross3(_vec("a", "b"), _vec("a", "c"))


def with_graph_stats(nodes: DataFrame, *aggs: Column) -> DataFrame:
    """Join per-graph aggregates back to rows; the statistics table has one row per graph."""
    return nodes.join(nodes.groupBy(G).agg(*aggs), G)


# ---- edges and weights -----------------------------------------------------------------------


def _length() -> Column:
    return F.sqrt(sum((F.col(f"{c}_d") - F.col(f"{c}_s")) * (F.col(f"{c}_d") - F.col(f"{c}_s")) for c in "xyz"))


def edge_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = endpoints(edges, nodes, ["x", "y", "z"])
    return out.select(*edges.columns, _length().alias("length"))


def edge_weights(edges: DataFrame, nodes: DataFrame, along=1.0, cross=0.3, floor=0.05) -> DataFrame:
    """Anisotropic conduction weight: alignment with the mean fibre, damped by mean fibrosis."""
    e = endpoints(edges, nodes, ["x", "y", "z", "fx", "fy", "fz", "fibrosis"])
    step = [F.col(f"{c}_d") - F.col(f"{c}_s") for c in "xyz"]
    fibre = [(F.col(f"f{c}_s") + F.col(f"f{c}_d")) / 2 for c in "xyz"]
    norms = F.sqrt(dot3(step, step)) * F.sqrt(dot3(fibre, fibre))
    align = F.when(norms > 1e-24, F.abs(dot3(step, fibre)) / norms).otherwise(F.lit(0.0))
    base = F.lit(cross) + F.lit(along - cross) * align * align
    keep = clip(1 - (F.col("fibrosis_s") + F.col("fibrosis_d")) / 2, floor, 1.0)
    return e.select(*edges.columns, (base * keep).alias("w"))


def attenuated_weights(edges: DataFrame, nodes: DataFrame, along=1.0, floor=0.05) -> DataFrame:
    e = endpoints(edges, nodes, ["fibrosis"])
    keep = clip(1 - (F.col("fibrosis_s") + F.col("fibrosis_d")) / 2, floor, 1.0)
    return e.select(*[c for c in edges.columns if c != "w"], (F.lit(along) * keep).alias("w"))


def mesh_to_graph(nodes: DataFrame, faces: DataFrame, along=1.0, cross=0.3, floor=0.05) -> tuple[DataFrame, DataFrame]:
    return nodes, edge_weights(mesh_edges(faces), nodes, along, cross, floor)


def cut_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Zero the weight of the edges listed in ids(graph_id, src, dst); unknown ids raise."""
    ids = ids.select(G, "src", "dst").distinct()
    unknown = ids.join(edges, [G, "src", "dst"], "left_anti").limit(1).count()
    if unknown:
        raise ValueError("cut_edges: an edge id is not in the graph")
    hit = edges.join(ids.withColumn("__hit", F.lit(True)), [G, "src", "dst"], "left")
    return hit.select(G, "src", "dst", F.when(F.col("__hit"), F.lit(0.0)).otherwise(F.col("w")).alias("w"))


# ---- vertex fields ---------------------------------------------------------------------------


def cell_scalar_to_vertex(faces: DataFrame, tag_values: dict[int, float]) -> DataFrame:
    """Mean over incident faces of a tag's value (0 for unlisted tags), clipped to [0,1]."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((int(k), float(v)) for k, v in tag_values.items())])
    c = corners(faces, "tag")
    val = F.coalesce(table[F.col("tag")], F.lit(0.0))
    return c.groupBy(G, "node_id").agg(clip(F.avg(val), 0.0, 1.0).alias("value"))


def cell_vector_to_vertex(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unit mean of incident face vectors; (1,0,0) where the mean vanishes or no face touches."""
    c = corners(faces, "vx", "vy", "vz")
    mean = c.groupBy(G, "node_id").agg(*[F.avg(f"v{k}").alias(f"m{k}") for k in "xyz"])
    j = nodes.select(G, "node_id").join(mean, [G, "node_id"], "left")
    m = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) for k in "xyz"]
    return j.select(G, "node_id", *[u.alias(f"f{k}") for u, k in zip(unit3(*m), "xyz")])


def default_fields(nodes: DataFrame) -> DataFrame:
    defaults = {"fx": 0.0, "fy": 0.0, "fz": 1.0, "u": 0.0, "v": 0.0, "fibrosis": 0.0, "region": 0}
    out = nodes
    for name, value in defaults.items():
        lit = F.lit(value).cast("long" if name == "region" else "double")
        out = out.withColumn(name, F.coalesce(F.col(name), lit) if name in nodes.columns else lit)
    return out


def drop_faces(nodes: DataFrame, faces: DataFrame, tags: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove tagged faces and unreferenced vertices; re-index densely. Third result: dropped counts."""
    dropped = faces.groupBy(G).agg(F.count_if(F.col("tag").isin(tags)).alias("n_dropped"))
    kept = faces.where(~F.col("tag").isin(tags))
    used = corners(kept).select(G, "node_id").distinct()
    nodes2, faces2, _ = reindex(nodes, used, faces=kept)
    return nodes2, faces2, dropped


def reindex(nodes: DataFrame, keep: DataFrame, faces: DataFrame | None = None, edges: DataFrame | None = None):
    """Restrict to keep(graph_id,node_id), renumbering vertices 0..n-1 in id order."""
    ids = row_numbers(keep.select(G, "node_id"), [G], [F.col("node_id")], "new_id")
    out_nodes = nodes.join(ids, [G, "node_id"]).withColumn("node_id", F.col("new_id")).drop("new_id")
    out_faces = out_edges = None
    if faces is not None:
        out_faces = faces
        for k in "abc":
            m = ids.select(G, F.col("node_id").alias(k), F.col("new_id").alias(f"__{k}"))
            out_faces = out_faces.join(m, [G, k])
        out_faces = out_faces.select(*[F.col(f"__{c}").alias(c) if c in "abc" else c for c in faces.columns])
    if edges is not None:
        out_edges = edges
        for k in ("src", "dst"):
            m = ids.select(G, F.col("node_id").alias(k), F.col("new_id").alias(f"__{k}"))
            out_edges = out_edges.join(m, [G, k])
        out_edges = out_edges.select(
            *[F.col(f"__{c}").alias(c) if c in ("src", "dst") else c for c in edges.columns]
        )
    return out_nodes, out_faces, out_edges


def assert_tags(faces: DataFrame, dead: list[int], drop: list[int]) -> None:
    """Raise when a dead tag is present but not in a non-empty drop list."""
    if not drop:
        return
    missed = [t for t in dead if t not in drop]
    found = faces.where(F.col("tag").isin(missed)).select("tag").distinct().limit(1).collect() if missed else []
    if found:
        raise ValueError(f"dead tag {found[0][0]} is present and not dropped")


def vector_spread(nodes: DataFrame, flag_below: float = 1e-6) -> DataFrame:
    """Mean distance of vertex vectors from their graph mean, with a degeneracy flag."""
    j = with_graph_stats(nodes, *[F.avg(f"f{k}").alias(f"m{k}") for k in "xyz"])
    d = F.sqrt(sum((F.col(f"f{k}") - F.col(f"m{k}")) * (F.col(f"f{k}") - F.col(f"m{k}")) for k in "xyz"))
    out = j.groupBy(G).agg(F.avg(d).alias("spread"))
    return out.withColumn("degenerate", F.col("spread") < flag_below)


def tag_fractions(faces: DataFrame) -> DataFrame:
    per = faces.groupBy(G, "tag").agg(F.count(F.lit(1)).alias("cnt"))
    total = per.groupBy(G).agg(F.sum("cnt").alias("total"))
    return per.join(total, G).select(G, "tag", "cnt", (F.col("cnt") / F.col("total")).alias("share"))


def rescale_mean(nodes: DataFrame, target: Column | float, col: str = "fibrosis") -> DataFrame:
    t = target if isinstance(target, Column) else F.lit(float(target))
    j = with_graph_stats(nodes, F.avg(col).alias("__mean"))
    new = F.when(F.col("__mean") > 0, clip(F.col(col) * t / F.col("__mean"), 0.0, 1.0)).otherwise(F.col(col))
    return j.withColumn(col, new).drop("__mean")


def quantise_half(nodes: DataFrame, col: str = "fibrosis") -> DataFrame:
    return nodes.withColumn(col, (F.col(col) > 0.5).cast("double"))


def quantise_burden(nodes: DataFrame, col: str = "fibrosis") -> DataFrame:
    """Binary field whose share of ones matches the mean: threshold at the (1-mean) quantile, strict."""
    counts = nodes.groupBy(G, col).agg(F.count(F.lit(1)).alias("__c"))
    stats = nodes.groupBy(G).agg(F.avg(col).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    from ..plans.ordered import running_sums

    run = running_sums(counts, [G], [F.col(col)], {"__before": F.col("__c")}).join(stats, G)
    pos = (F.col("__n") - 1) * clip(1 - F.col("__mean"), 0.0, 1.0)
    at = lambda p: F.max(
        F.when((F.col("__before") <= p) & (p < F.col("__before") + F.col("__c")), F.col(col))
    )
    cut = run.groupBy(G).agg(
        at(F.floor(pos)).alias("lo"), at(F.ceil(pos)).alias("hi"), F.max(pos - F.floor(pos)).alias("f"),
        F.max("__mean").alias("__mean"),
    )
    cut = cut.select(G, "__mean", (F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))).alias("__t"))
    new = (
        F.when(F.col("__mean") <= 0, 0.0).when(F.col("__mean") >= 1, 1.0)
        .otherwise((F.col(col) > F.col("__t")).cast("double"))
    )
    return nodes.join(cut, G).withColumn(col, new).drop("__mean", "__t")


def kernel_field(
    nodes: DataFrame, centres: DataFrame, target: float, sigma_scale: float | None = None, sigma: float | None = None
) -> DataFrame:
    """Sum of Gaussian bumps at centres(graph_id,cx,cy,cz,amp), scaled to max 1, then to a target mean.

    Up to PACKED_ROWS centres per graph are folded into one array, so no node-centre pairs are
    emitted; longer lists meet the nodes in a salted join.
    """
    if sigma is None:
        box = [F.max(c) - F.min(c) for c in "xyz"]
        diag = F.sqrt(dot3(box, box))
        nodes2 = with_graph_stats(nodes, F.greatest(diag * sigma_scale, F.lit(1e-9)).alias("__s"))
    else:
        nodes2 = nodes.withColumn("__s", F.lit(max(float(sigma), 1e-9)))
    sq = lambda a, b: (F.col(a) - b) * (F.col(a) - b)
    bump = lambda c: c["amp"] * F.exp(
        -(sq("x", c["cx"]) + sq("y", c["cy"]) + sq("z", c["cz"])) / (2 * F.col("__s") * F.col("__s"))
    )
    if largest_group(centres, [G]) <= PACKED_ROWS:
        packed = centres.groupBy(G).agg(F.collect_list(F.struct("cx", "cy", "cz", "amp")).alias("__c"))
        raw = nodes2.join(packed, G).withColumn("__f", F.aggregate("__c", F.lit(0.0), lambda acc, c: acc + bump(c)))
    else:
        pairs = salted(nodes2.select(G, "node_id", "x", "y", "z", "__s"), centres, [G], ["node_id"])
        per = pairs.groupBy(G, "node_id").agg(F.sum(bump({k: F.col(k) for k in ("cx", "cy", "cz", "amp")})).alias("__f"))
        raw = nodes2.join(per, [G, "node_id"])
    j = with_graph_stats(raw, F.max("__f").alias("__max"), F.avg("__f").alias("__avg"))
    scaled = F.col("__f") / F.col("__max") * F.lit(target) / (F.col("__avg") / F.col("__max"))
    out = j.withColumn("field", F.when(F.col("__max") > 0, clip(scaled, 0.0, 1.0)).otherwise(F.lit(0.0)))
    return out.drop("__c", "__s", "__f", "__max", "__avg")


def site_mask(nodes: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """Nodes within `radius` of any site(graph_id,site,node_id); if none, the first site itself."""
    s = sites.join(nodes.select(G, "node_id", "x", "y", "z"), [G, "node_id"])
    first = sites.groupBy(G).agg(F.min_by("node_id", "site").alias("__first"))
    sq = lambda a, b: (F.col(a) - b) * (F.col(a) - b)
    near = lambda p: sq("x", p["x"]) + sq("y", p["y"]) + sq("z", p["z"]) <= F.lit(radius * radius)
    if largest_group(sites, [G]) <= PACKED_ROWS:
        packed = s.groupBy(G).agg(F.collect_list(F.struct("x", "y", "z")).alias("__p"))
        j = nodes.join(packed, G).join(first, G).withColumn("hit", F.exists("__p", near))
    else:
        far = s.select(G, *[F.col(c).alias(f"p{c}") for c in "xyz"])
        pairs = salted(nodes.select(G, "node_id", "x", "y", "z"), far, [G], ["node_id"])
        per = pairs.groupBy(G, "node_id").agg(F.bool_or(near({c: F.col(f"p{c}") for c in "xyz"})).alias("hit"))
        j = nodes.join(per, [G, "node_id"]).join(first, G)
    j = with_graph_stats(j, F.max("hit").alias("__any"))
    hit = F.when(F.col("__any"), F.col("hit")).otherwise(F.col("node_id") == F.col("__first"))
    return j.withColumn("hit", hit).drop("__p", "__first", "__any")


# ---- geometry --------------------------------------------------------------------------------


def vertex_normals(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    n = face_normal()
    fp = face_points(faces, nodes).select(G, "face_id", "a", "b", "c", *[v.alias(f"n{k}") for v, k in zip(n, "xyz")])
    s = corners(fp, "nx", "ny", "nz").groupBy(G, "node_id").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in "xyz"])
    j = nodes.select(G, "node_id").join(s, [G, "node_id"], "left")
    m = [F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in "xyz"]
    return j.select(G, "node_id", *[u.alias(f"n{k}") for u, k in zip(unit3(*m, fallback=(0.0, 0.0, 0.0), floor=0.0), "xyz")])


def tangent_field(normals: DataFrame, d=(0.0, 0.0, 1.0), fallback=(1.0, 0.0, 0.0)) -> DataFrame:
    """Unit tangential part of a direction; the fallback axis where the projection is tiny."""
    n = [F.col(f"n{k}") for k in "xyz"]

    def proj(v):
        vv = [F.lit(float(c)) for c in v]
        dn = dot3(vv, n)
        return [c - dn * k for c, k in zip(vv, n)]

    p, q = proj(d), proj(fallback)
    small = F.sqrt(dot3(p, p)) < 1e-6
    t = [F.when(small, b).otherwise(a) for a, b in zip(p, q)]
    mag = F.sqrt(dot3(t, t))
    mag = F.when(mag > 0, mag).otherwise(F.lit(1.0))
    return normals.select(G, "node_id", *[(c / mag).alias(f"f{k}") for c, k in zip(t, "xyz")])


def geometry_summary(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    """Area, mean (non-unique) edge length and burden statistics per graph."""
    from ..plans.ordered import quantiles

    n = face_normal()
    fp = face_points(faces, nodes)
    side = lambda p, q: F.sqrt(dot3(_vec(p, q), _vec(p, q)))
    area = fp.groupBy(G).agg(
        F.sum(F.sqrt(dot3(n, n)) / 2).alias("area"),
        F.avg((side("a", "b") + side("b", "c") + side("a", "c")) / 3).alias("mean_edge"),
    )
    stat = nodes.groupBy(G).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.avg("fibrosis").alias("mean_fib"),
        F.avg((F.col("fibrosis") > 0.5).cast("double")).alias("share_half"),
    )
    p90 = quantiles(nodes, [G], "fibrosis", {"p90_fib": 0.9})
    return stat.join(area, G).join(p90, G)


def cohort_spread(summary: DataFrame, cohort: Column, cols: list[str]) -> DataFrame:
    """Mean, population sd, min, max of each graph-level column per cohort."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return summary.groupBy(cohort.alias("cohort")).agg(*aggs)


def euler(faces: DataFrame) -> DataFrame:
    v = corners(faces).select(G, "node_id").distinct().groupBy(G).agg(F.count(F.lit(1)).alias("n_v"))
    e = mesh_edges(faces).groupBy(G).agg(F.count(F.lit(1)).alias("n_e"))
    f = faces.groupBy(G).agg(F.count(F.lit(1)).alias("n_f"))
    return v.join(e, G).join(f, G).withColumn("chi", F.col("n_v") - F.col("n_e") + F.col("n_f"))


def euler_census(faces: DataFrame, drop_tag: int) -> DataFrame:
    """Per graph: chi before and after removing a tag, and the change."""
    before = euler(faces).select(G, F.col("chi").alias("chi_before"))
    after = euler(faces.where(F.col("tag") != drop_tag)).select(G, F.col("chi").alias("chi_after"))
    j = before.join(after, G, "left").na.fill({"chi_after": 0})
    return j.withColumn("delta_chi", F.col("chi_before") - F.col("chi_after"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """Face pairs (f1<f2) across edges with exactly two incident faces."""
    per = face_edges(faces, "tag").groupBy(G, "src", "dst").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("face_id", "tag")).alias("lo"), F.max(F.struct("face_id", "tag")).alias("hi")
    )
    return per.where("c = 2").select(
        G, F.col("lo.face_id").alias("f1"), F.col("hi.face_id").alias("f2"), F.col("lo.tag").alias("t1"), F.col("hi.tag").alias("t2")
    )


def contact_fraction(faces: DataFrame, a: int, b: int) -> DataFrame:
    t1, t2 = F.col("t1"), F.col("t2")
    touch = ((t1 == a) & (t2 == b)) | ((t1 == b) & (t2 == a))
    adj = face_adjacency(faces).groupBy(G).agg(
        F.count_if(touch).alias("touching"), F.count_if((t1 == a) | (t2 == a)).alias("incident")
    )
    return adj.withColumn("contact", F.col("touching") / F.greatest(F.col("incident"), F.lit(1)))


def tag_components(faces: DataFrame, tag: int, share: float = 0.01) -> DataFrame:
    """Number of same-tag face components holding at least `share` of that tag's faces."""
    own = faces.where(F.col("tag") == tag)
    links = face_adjacency(own).select(G, F.col("f1").alias("src"), F.col("f2").alias("dst"))
    comp = components(links, own.select(G, F.col("face_id").alias("node_id")))
    sizes = comp.groupBy(G, "comp").agg(F.count(F.lit(1)).alias("c"))
    total = own.groupBy(G).agg(F.count(F.lit(1)).alias("t"))
    return sizes.join(total, G).groupBy(G).agg(
        F.count_if(F.col("c") >= F.lit(share) * F.col("t")).alias("n_large"), F.count(F.lit(1)).alias("n_comp")
    )


def cotangent(nodes: DataFrame, faces: DataFrame, w_ref: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Cotangent edge transmissibility scaled by the relative conduction weight, and lumped vertex mass."""
    n = face_normal()
    fp = face_points(faces, nodes).withColumn("area", F.greatest(F.sqrt(dot3(n, n)) / 2, F.lit(1e-12)))
    mass = corners(fp, "area").groupBy(G, "node_id").agg(F.greatest(F.sum(F.col("area") / 3), F.lit(1e-9)).alias("mass"))
    mass = nodes.select(G, "node_id").join(mass, [G, "node_id"], "left").na.fill({"mass": 1e-9})

    def item(p, q, o):
        return F.struct(
            F.least(p, q).alias("src"), F.greatest(p, q).alias("dst"),
            (dot3(_vec(o, p), _vec(o, q)) / (2 * F.col("area")) / 2).alias("half"),
        )

    per = fp.select(G, F.explode(F.array(item("a", "b", "c"), item("b", "c", "a"), item("a", "c", "b"))).alias("e"))
    cot = per.groupBy(G, "e.src", "e.dst").agg(F.greatest(F.sum("e.half"), F.lit(1e-4)).alias("cot"))
    e = edge_weights(cot, nodes).select(G, "src", "dst", (F.col("cot") * F.col("w") / F.lit(w_ref)).alias("w"))
    return e, mass


def grid_regions(nodes: DataFrame, na: int = 3, nb: int = 3) -> DataFrame:
    return nodes.withColumn("region", grid_region(F.col("u"), F.col("v"), na, nb))


def sample_nodes(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """k distinct nodes per graph (all of them when k exceeds n), by smallest draw."""
    from ..functions.rng import uniform

    drawn = nodes.select(G, "node_id").withColumn("__u", uniform(seed, G, "node_id"))
    ranked = row_numbers(drawn, [G], [F.col("__u"), F.col("node_id")], "pos")
    return ranked.where(F.col("pos") < max(int(k), 1)).select(G, "node_id", "pos")


def pca_chart(nodes: DataFrame) -> DataFrame:
    """Top-two principal axes as a [0,1]^2 chart; each axis is signed so its largest component is positive."""
    pair = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = nodes.groupBy(G).agg(
        *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in pair]
    )
    axes = cov.mapInPandas(_principal_axes, "graph_id string, mx double, my double, mz double, " + ", ".join(f"p{i}{c} double" for i in (1, 2) for c in "xyz"))
    j = nodes.join(axes, G)
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    j = j.withColumn("__p", dot3(d, [F.col(f"p1{c}") for c in "xyz"])).withColumn("__q", dot3(d, [F.col(f"p2{c}") for c in "xyz"]))
    box = j.groupBy(G).agg(
        F.min("__p").alias("p0"), F.greatest(F.max("__p") - F.min("__p"), F.lit(1e-9)).alias("pr"),
        F.min("__q").alias("q0"), F.greatest(F.max("__q") - F.min("__q"), F.lit(1e-9)).alias("qr"),
    )
    u = clip((F.col("__p") - F.col("p0")) / F.col("pr"), 0.0, 1.0)
    v = clip((F.col("__q") - F.col("q0")) / F.col("qr"), 0.0, 1.0)
    drop = ["__p", "__q", "p0", "pr", "q0", "qr", "mx", "my", "mz", *[f"p{i}{c}" for i in (1, 2) for c in "xyz"]]
    return j.join(box, G).withColumn("u", u).withColumn("v", v).drop(*drop)


def _principal_axes(batches):
    """Eigenvectors of each graph's 3x3 covariance, many graphs per batch."""
    for pdf in batches:
        m = pdf[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy().reshape(-1, 3, 3)
        vec = np.linalg.eigh(m)[1]
        out = pdf[[G, "mx", "my", "mz"]].copy()
        for i, col in ((1, 2), (2, 1)):
            v = vec[:, :, col]
            top = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
            out[[f"p{i}{c}" for c in "xyz"]] = v * np.sign(top)
        yield out


# ---- coarsening ------------------------------------------------------------------------------

LINE = 1e-12  # a mean this close below a line of the region grid is on it


def coarsen(nodes: DataFrame, faces: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering on a cubic grid, every graph bisecting its own resolution in the same rounds."""
    from ..plans.lineage import cut
    from .components import largest_component

    box = nodes.groupBy(G).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"l{c}") for c in "xyz"],
        *[F.greatest(F.max(c) - F.min(c), F.lit(1e-9)).alias(f"e{c}") for c in "xyz"],
    )
    big = cut(box.where(F.col("n") > target))
    unit = nodes.join(big, G).select(G, "node_id", *[((F.col(c) - F.col(f"l{c}")) / F.col(f"e{c}")).alias(f"g{c}") for c in "xyz"])
    unit = cut(unit)
    cell = lambda c: clip(F.floor(F.col(f"g{c}") * F.col("res")), 0, F.col("res") - 1)
    state = big.select(G, F.lit(2).alias("lo"), F.lit(512).alias("hi"), F.lit(257).alias("res"), F.lit(False).alias("done"))
    for _ in range(24):
        live = state.where("not done")
        occupied = unit.join(live.select(G, "res"), G).select(G, *[cell(c).alias(f"k{c}") for c in "xyz"]).distinct()
        cnt = occupied.groupBy(G).agg(F.count(F.lit(1)).alias("cnt"))
        j = state.join(cnt, G, "left")
        under, over = F.col("cnt") < target, F.col("cnt") > int(target * 1.15)
        lo = F.when(~F.col("done") & under, F.col("res") + 1).otherwise(F.col("lo"))
        hi = F.when(~F.col("done") & ~under & over, F.col("res") - 1).otherwise(F.col("hi"))
        done = F.col("done") | (~under & ~over) | (lo > hi)
        nxt = F.when(done, F.col("res")).otherwise(F.floor((lo + hi) / 2).cast("int"))
        state = cut(j.select(G, lo.alias("lo"), hi.alias("hi"), nxt.alias("res"), done.alias("done")))
        if state.where("not done").limit(1).count() == 0:
            break
    key = F.struct(*[cell(c).alias(f"k{c}") for c in "xyz"])
    member = unit.join(state.select(G, "res"), G).select(G, "node_id", key.alias("cell"))
    cells = member.select(G, "cell").distinct()
    from ..plans.ordered import row_numbers as number

    cells = number(cells, [G], [F.col("cell.kx"), F.col("cell.ky"), F.col("cell.kz")], "cid")
    member = cut(member.join(cells, [G, "cell"]).select(G, "node_id", "cid"))
    agg = nodes.join(member, [G, "node_id"]).groupBy(G, "cid").agg(
        *[F.avg(c).alias(c) for c in ("x", "y", "z", "fibrosis", "u", "v")], *[F.sum(f"f{k}").alias(f"s{k}") for k in "xyz"]
    )
    fib = unit3(*[F.col(f"s{k}") for k in "xyz"])
    # Means of many cells lie on a line of the grid: the last digits of a sum, which depend on its order, do not decide there.
    above = [F.col(c) + F.lit(LINE) for c in "uv"]
    new_nodes = agg.select(
        G, F.col("cid").alias("node_id"), "x", "y", "z", *[f.alias(f"f{k}") for f, k in zip(fib, "xyz")],
        "fibrosis", "u", "v", grid_region(*above).alias("region"),
    )
    mapped = faces.select(G, "a", "b", "c")
    for k in "abc":
        mapped = mapped.join(member.select(G, F.col("node_id").alias(k), F.col("cid").alias(f"m{k}")), [G, k])
    tri = F.sort_array(F.array("ma", "mb", "mc"))
    mapped = mapped.where("ma <> mb and mb <> mc and ma <> mc").select(G, tri.alias("t")).distinct()
    mapped = mapped.select(G, *[F.col("t")[i].alias(k) for i, k in enumerate("abc")])
    mapped = number(mapped, [G], [F.col("a"), F.col("b"), F.col("c")], "face_id")
    keep = largest_component(new_nodes, mesh_edges(mapped))
    out_nodes, out_faces, _ = reindex(new_nodes, keep, faces=mapped)
    small = nodes.join(big.select(G), G, "left_anti").select(*out_nodes.columns)
    return (
        out_nodes.unionByName(small),
        out_faces.select(G, "face_id", "a", "b", "c").unionByName(faces.join(big.select(G), G, "left_anti").select(G, "face_id", "a", "b", "c")),
    )
