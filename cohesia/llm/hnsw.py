"""Near-duplicate vectors by navigable small-world graphs: one graph a shard, every shard asked, cosines verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, saved

SHARD = 32_768  # vectors of a graph, about
BLOCK = 8_192  # queries of a task, about
DEGREE = 12  # links a node makes in each layer; layer 0 holds twice as many
BEAM = 48
AUDIT = 64  # queries of a block that are also compared with the whole shard
RECALL = 0.999  # of the audited links; below it the beam doubles
WIDE = 4  # nodes a search expands at once, at least
CELLS = 1 << 19  # queries times beam held at once


def _search(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: ids and similarities of the `beam` best nodes met (-1: none).

    near: neighbours of each node, -1 for none. entry: start nodes of each query.
    """
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1)
    sims = np.full((n, beam), -2, np.float32)
    e = entry.shape[1]
    take = min(e, beam)
    start = np.where(entry >= 0, np.einsum("ned,nd->ne", x[entry], q), np.float32(-2))
    ids[:, :take], sims[:, :take] = entry[:, :take], start[:, :take]
    seen = np.zeros((n, len(x)), bool)
    seen[rows, np.maximum(entry, 0)] = True
    fresh = sims > -2
    live = np.arange(n)
    wide = max(WIDE, beam // 8)
    while len(live):
        part = np.where(fresh[live], sims[live], np.float32(-3))
        top = np.argpartition(-part, min(wide, beam - 1), 1)[:, :wide]
        r = np.arange(len(live))[:, None]
        good = part[r, top] > -3
        fresh[live[:, None], top] = False
        node = np.where(good, ids[live[:, None], top], -1)
        next_ = np.where(node[:, :, None] >= 0, near[node], -1).reshape(len(live), -1)
        next_.sort(1)
        ok = next_ >= 0
        ok[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        ok &= ~seen[live[:, None], np.maximum(next_, 0)]
        at_r, at_c = np.nonzero(ok)
        to = next_[at_r, at_c]
        seen[live[at_r], to] = True
        sim = np.full(next_.shape, -2, np.float32)
        sim[at_r, at_c] = np.einsum("nd,nd->n", x[to], q[live[at_r]])
        all_sims = np.concatenate([sims[live], sim], 1)
        best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        sims[live] = all_sims[r, best]
        ids[live] = np.concatenate([ids[live], next_], 1)[r, best]
        fresh[live] = np.concatenate([fresh[live], ok], 1)[r, best] & (sims[live] > -2)
        live = live[fresh[live].any(1)]
    order = np.argsort(-sims, 1, kind="stable")
    return np.where(sims[rows, order] > -2, ids[rows, order], -1), sims[rows, order]


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each node the best candidates that are closer to it than to a candidate chosen before, then the best others."""
    order = np.argsort(-sims, 1, kind="stable")
    r = np.arange(len(own))[:, None]
    cand, sims = cand[r, order], sims[r, order]
    valid = (cand >= 0) & (cand != own[:, None])
    out = np.full((len(own), degree), -1)
    count = np.zeros(len(own), np.int64)
    used = np.zeros(cand.shape, bool)
    for c in range(cand.shape[1]):
        rows = np.flatnonzero(valid[:, c] & (count < degree))
        if not len(rows):
            continue
        chosen = out[rows]
        to = np.einsum("nkd,nd->nk", x[chosen], x[cand[rows, c]])
        free = ~((chosen >= 0) & (to >= sims[rows, c][:, None])).any(1)
        rows = rows[free]
        out[rows, count[rows]] = cand[rows, c]
        count[rows] += 1
        used[rows, c] = True
    for c in range(cand.shape[1]):
        rows = np.flatnonzero(valid[:, c] & ~used[:, c] & (count < degree))
        out[rows, count[rows]] = cand[rows, c]
        count[rows] += 1
    return out


def _link_back(x: np.ndarray, near: np.ndarray, new: np.ndarray) -> None:
    """Give the new nodes' neighbours a link to them; a full list keeps a diverse choice."""
    degree = near.shape[1]
    src = np.repeat(new, degree)
    dst = near[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    for a in range(0, len(nodes), 4096):
        part, width = nodes[a : a + 4096], int(count[a : a + 4096].max())
        width = min(width, 64)  # a hub takes its 64 closest new links at most; the others still lead to it
        extra = np.full((len(part), width), -1)
        for i, (f, c) in enumerate(zip(first[a : a + 4096], count[a : a + 4096])):
            own = src[f : f + c]
            if c > width:
                own = own[np.argsort(-(x[own] @ x[part[i]]), kind="stable")[:width]]
            extra[i, : len(own)] = own
        cand = np.concatenate([near[part], extra], 1)
        free = (near[part] >= 0).sum(1) + (extra >= 0).sum(1) <= degree
        easy = np.flatnonzero(free)
        packed = -np.sort(-cand[easy], 1)[:, :degree]
        near[part[easy]] = packed
        full = np.flatnonzero(~free)
        if len(full):
            sims = np.where(cand[full] >= 0, np.einsum("nkd,nd->nk", x[cand[full]], x[part[full]]), np.float32(-2))
            near[part[full]] = _diverse(x, part[full], cand[full], sims, degree)


class Graph:
    """Layers of a shard, highest first: nodes (in insertion order) and the neighbours of each vector."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        if n:
            level[0] = max(level.max(), 1)
        self.layers: list[np.ndarray] = []
        self.entry = 0
        for k in range(int(level.max()) if n else 0, -1, -1):
            nodes = np.flatnonzero(level >= k)
            order = np.argsort(-level[nodes], kind="stable")
            self._layer(nodes[order], 2 * DEGREE if k == 0 else DEGREE)

    def _layer(self, nodes: np.ndarray, degree: int) -> None:
        near = np.full((len(self.x), degree), -1, np.int32)
        x, done = self.x, 0
        while done < len(nodes):
            batch = nodes[done : done + max(min(done, 2048), 256)]
            mates = x[batch] @ x[batch].T
            np.fill_diagonal(mates, -2)
            k = min(degree, len(batch))
            top = np.argpartition(-mates, k - 1, 1)[:, :k]
            cand, sims = batch[top], np.take_along_axis(mates, top, 1)
            if done:
                found, s = [], []
                for a in range(0, len(batch), 1024):
                    e = self._descend(x[batch[a : a + 1024]], len(self.layers)) if self.layers else np.full((len(batch[a : a + 1024]), 1), nodes[0])
                    i, v = _search(x, near, x[batch[a : a + 1024]], e, BEAM)
                    found.append(i), s.append(v)
                cand, sims = np.concatenate([cand, np.concatenate(found)], 1), np.concatenate([sims, np.concatenate(s)], 1)
            near[batch] = _diverse(x, batch, cand, sims, degree)
            _link_back(x, near, batch)
            done += len(batch)
        self.layers.append(near)
        self.entry = int(nodes[0])

    def _descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        e = np.full((len(q), 1), self.entry)
        for near in self.layers[:layers]:
            e = _search(self.x, near, q, e, 4)[0][:, :2]
        return e

    def find(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        step = max(1, min(1024, CELLS // beam))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            out.append(_search(self.x, self.layers[-1], part, self._descend(part, len(self.layers) - 1), min(beam, max(len(self.x), WIDE + 1))))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _pairs(graph: Graph, vectors: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and node of every pair found whose cosine in double precision is at least `least`.

    A query whose beam ends above the threshold is asked again with a beam twice as wide; the whole block
    is, if the audited queries miss links.
    """
    norm, qn = np.linalg.norm(vectors, axis=1), np.linalg.norm(q, axis=1)
    unit = _unit(q)
    near_least = least - 1e-4  # single precision only preselects

    def sure(a, b):
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            keep[s : s + (1 << 16)] = np.einsum("nd,nd->n", q[i], vectors[j]) / (qn[i] * norm[j]) >= least
        return a[keep], b[keep]

    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth_a, truth_b = sure(*[v if k else audit[v] for k, v in enumerate(np.nonzero(unit[audit] @ graph.x.T >= near_least))])
    truth = truth_a * len(vectors) + truth_b
    beam = BEAM
    while True:
        got_a, got_b = [], []
        todo, width = np.arange(len(q)), beam
        while len(todo):
            again = []
            for s in range(0, len(todo), max(1, min(1024, CELLS // width))):
                part = todo[s : s + max(1, min(1024, CELLS // width))]
                if width > beam and 8 * width >= len(vectors):  # a beam this wide costs more than the whole shard
                    r, c = np.nonzero(unit[part] @ graph.x.T >= near_least)
                    got_a.append(part[r]), got_b.append(c)
                    continue
                ids, sims = graph.find(unit[part], width)
                open_ = (sims[:, -1] >= near_least) & (width < len(vectors))
                again.append(part[open_])
                r, c = np.nonzero((sims >= near_least) & ~open_[:, None] & (ids >= 0))
                got_a.append(part[r]), got_b.append(ids[r, c])
            todo, width = np.concatenate(again) if again else todo[:0], 2 * width
        a, b = sure(np.concatenate(got_a), np.concatenate(got_b))
        if not len(truth) or np.isin(truth, a * len(vectors) + b).mean() >= RECALL or beam >= len(vectors):
            return a, b
        beam *= 2


def near_vectors(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in
    double precision is at least `least`. Null, empty and zero vectors, and those with a null or non-finite
    component, link with nothing. Equal vectors of a label are one node with a count; repeated rows of a
    vec_id with the same vector count once. Other columns are ignored; an empty table gives no rows.

    Every (label, length) is dealt by hash into shards of about `shard` nodes; a graph is built for each,
    and each block of about `block` queries of the label asks every shard. Tasks return link counts and a
    spanning forest of the links.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    nodes = saved(usable.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("vec_id").alias("n")), "nodes")
    kinds = nodes.groupBy("label", F.size("v").alias("d")).agg(F.ceil(F.count("id") / shard).alias("shards"), F.ceil(F.count("id") / block).alias("blocks"))
    kinds = F.broadcast(saved(kinds, "kinds"))  # a row for each label and length
    dealt = nodes.withColumn("d", F.size("v")).join(kinds, ["label", "d"])
    dealt = dealt.select("label", "d", F.pmod(F.xxhash64("id"), F.col("shards")).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).alias("block"), "id", "n", "v")
    key = ["label", "d"]

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def build(batches):
        for t in groups(batches, 3):
            v = matrix(t)
            g = Graph(_unit(v))
            layers = pa.array([[layer.tobytes() for layer in g.layers]], pa.list_(pa.binary()))
            first = t.slice(0, 1).select(["label", "d", "shard"]).combine_chunks().to_batches()[0]
            yield pa.record_batch([*first.columns, pa.array([t.column("id").to_numpy().tobytes()]), pa.array([t.column("n").to_numpy().tobytes()]), pa.array([v.tobytes()]), layers, pa.array([g.entry], pa.int64())], names=["label", "d", "shard", "ids", "counts", "vectors", "layers", "entry"])

    def pack(batches):
        for t in groups(batches, 3):
            first = t.slice(0, 1).select(["label", "d", "block"]).combine_chunks().to_batches()[0]
            yield pa.record_batch([*first.columns, pa.array([t.column("id").to_numpy().tobytes()]), pa.array([matrix(t).tobytes()])], names=["label", "d", "block", "q_ids", "q"])

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                v = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
                g = Graph.__new__(Graph)
                g.x, g.entry = _unit(v), row["entry"]
                g.layers = [np.frombuffer(layer, np.int32).reshape(len(ids), -1) for layer in row["layers"]]
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                a, c = _pairs(g, v, np.frombuffer(row["q"]).reshape(len(q_ids), -1), least)
                other = q_ids[a] != ids[c]
                a, c = a[other], c[other]
                links = np.bincount(a, counts[c], minlength=len(q_ids)).astype(np.int64)
                forest = _forest(q_ids[a], ids[c])
                yield pa.record_batch([pa.array(np.concatenate([q_ids, forest[:, 0]])), pa.array(np.concatenate([np.full(len(q_ids), -1), forest[:, 1]]), mask=np.arange(len(q_ids) + len(forest)) < len(q_ids)), pa.array(np.concatenate([links, np.zeros(len(forest), np.int64)]))], names=["a", "b", "n"])

    wide = kinds.select(F.sum("shards"), F.sum("blocks")).first()
    shards, blocks = [max(1, int(x or 1)) for x in wide]
    graphs = dealt.select(*key, "shard", "id", "n", "v").repartition(shards, *key, "shard").sortWithinPartitions(*key, "shard", "id")
    graphs = saved(graphs.mapInArrow(build, "label string, d int, shard long, ids binary, counts binary, vectors binary, layers array<binary>, entry long"), "graphs")
    queries = dealt.select(*key, "block", "id", "v").repartition(blocks, *key, "block").sortWithinPartitions(*key, "block", "id")
    queries = saved(queries.mapInArrow(pack, "label string, d int, block long, q_ids binary, q binary"), "blocks")
    asked = graphs.join(queries.hint("shuffle_hash"), key).repartition(shards * blocks if shards * blocks < 10_000 else 10_000, *key, "shard", "block")
    found = saved(asked.mapInArrow(ask, "a long, b long, n long"), "links")

    linked = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    known = nodes.join(counts, nodes["id"] == counts["a"], "left").drop("a").join(linked.withColumnRenamed("id", "l"), F.col("id") == F.col("l"), "left")
    known = known.select(F.col("label").alias("kl"), F.col("v").alias("kv"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("kl")) & (F.col("v") == F.col("kv")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most one edge a node with the same components as the edges (a, b)."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    lab = np.arange(len(ids))
    while True:
        new = lab.copy()
        np.minimum.at(new, x, lab[y])
        np.minimum.at(new, y, lab[x])
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    own = np.flatnonzero(lab != np.arange(len(lab)))
    return np.column_stack([ids[own], ids[lab[own]]])
