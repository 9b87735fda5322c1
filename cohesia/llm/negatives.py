"""Hard negatives by Kronecker-packed products: several candidates' components in fields of one wide integer.

The components of a group of candidates are biased to be non-negative and laid side by side in fields of
one integer, wide enough that a whole inner product fits a field. One multiplication of the packed integer
by an anchor's (biased) component then serves the whole group, the products are summed, and the fields of
the sum, less the bias, are the exact scores. The wide integer is the 53-bit significand of a double as
long as at least one field fits, so that matrix products do the multiplications, exactly; wider ranges use
Python's integers of any width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import width
from .blocks import by_bytes, dealt, fresh, matrix, packed, pieces, rows_of, unpacked, usable
from .common import saved

WORD = 53  # bits of a double's significand
LONG = (1 << 63) - 1
NONE = -LONG - 1  # score of no row
BLOCK_BYTES = 1 << 20  # of a block of candidates or anchors, about
BLOCK_ROWS = 8192
CELLS = 1 << 19  # scores held at once
GROUP = 16  # candidate blocks that a task compares with one block of anchors, at most
BLOCK = "no long, d int, n int, ids binary, labels binary, v binary, kind string, names array<long>"


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a and c (integers held as doubles), exact; beyond a long they saturate."""
    if not len(a) or not len(c):
        return np.zeros((len(a), len(c)), np.int64)
    bias_a, bias_c = max(0, -int(a.min())), max(0, -int(c.min()))
    field = (a.shape[1] * (int(a.max()) + bias_a) * (int(c.max()) + bias_c)).bit_length() or 1
    if field > WORD or max(bias_a, bias_c, int(a.max()), int(c.max())) >> WORD:
        return _wide_products(a, c, bias_a, bias_c)
    fields = WORD // field
    a, c = a + bias_a, c + bias_c
    groups = -(-len(c) // fields)
    full = np.zeros((groups * fields, c.shape[1]))
    full[: len(c)] = c
    word = np.zeros((groups, c.shape[1]))
    for f in range(fields):
        word += full[f * groups : (f + 1) * groups] * float(1 << (field * f))
    total = (a @ word.T).astype(np.int64)  # every partial sum is an integer below 2 ** WORD
    out = np.concatenate([total >> (field * f) & ((1 << field) - 1) for f in range(fields)], 1)[:, : len(c)]
    return out - (bias_c * a.sum(1)).astype(np.int64)[:, None] - (bias_a * c.sum(1)).astype(np.int64)[None, :] + a.shape[1] * bias_a * bias_c


def _wide_products(a: np.ndarray, c: np.ndarray, bias_a: int, bias_c: int) -> np.ndarray:
    ints = lambda m, bias: [[int(x) + bias for x in row] for row in m]
    ua, uc = ints(a, bias_a), ints(c, bias_c)
    d = a.shape[1]
    size = ((d * max(map(max, ua)) * max(map(max, uc))).bit_length() + 7) // 8 or 1
    word = [int.from_bytes(b"".join(row[k].to_bytes(size, "little") for row in uc), "little") for k in range(d)]
    sum_c = [sum(row) for row in uc]
    out = np.empty((len(a), len(c)), np.int64)
    for i, row in enumerate(ua):
        total = sum(x * w for x, w in zip(row, word)).to_bytes(size * len(uc), "little")
        lead = d * bias_a * bias_c - bias_c * sum(row)
        for j, s in enumerate(sum_c):
            exact = int.from_bytes(total[j * size : (j + 1) * size], "little") + lead - bias_a * s
            out[i, j] = min(max(exact, -LONG), LONG)
    return out


def integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles, which hold it exactly."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(256.0 * v, -1.7e308, 1.7e308)) + 0.0


class Best:
    """The k first (score descending, id ascending) of the rows met for each of m lists."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score = np.full((m, k), NONE)
        self.id = np.full((m, k), LONG)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows given as parallel arrays."""
        worst = self.score[lists, -1]
        keep = (score > worst) | (score == worst) & (ids < self.id[lists, -1])
        lists, score, ids = lists[keep], score[keep], ids[keep]
        if not len(lists):
            return
        own = np.unique(lists)
        lists = np.concatenate([np.repeat(own, self.k), lists])
        score, ids = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, ~score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        first = np.searchsorted(lists, own)
        at = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        top = at < self.k
        self.score[lists[top], at[top]], self.id[lists[top], at[top]] = score[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.nonzero(self.score > NONE)
        return at[0], self.score[at], self.id[at]


def _blocks(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Blocks of rows(d, label, vec_id, v) that are sorted by those columns: exact repeats once, a block of one length."""

    def pack(batches):
        shard, seq, last = TaskContext.get().partitionId(), 0, None
        limit = lambda d: max(1, min(block_rows, BLOCK_BYTES // (2 * int(d))))
        for t in pieces(batches, "d", limit):
            d = t.column("d")[0].as_py()
            ids, labels, v = t.column("vec_id").to_numpy(), t.column("label").to_numpy(), integers(matrix(t.column("v"), d))
            row = (ids[-1:], labels[-1:], v[-1:])
            keep = fresh(ids, labels, v)
            if last is not None and last[2].shape[1] == d:
                keep[0] &= not all((x == y[:1]).all() for x, y in zip(last, (ids, labels, v)))
            last = row
            if not keep.any():
                continue
            ids, labels = ids[keep], labels[keep]
            data, kind = packed(v[keep])
            yield pa.record_batch([pa.array([shard << 32 | seq], pa.int64()), pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([labels.astype("<i8").tobytes()]), pa.array([data]), pa.array([kind]), pa.array([np.unique(labels).tolist()], pa.list_(pa.int64()))], names=["no", "d", "n", "ids", "labels", "v", "kind", "names"])
            seq += 1

    keys = ["d", "label", "vec_id", "v"]
    ordered = rows.repartitionByRange(n, "d", "label", "vec_id").sortWithinPartitions(*keys)
    return saved(ordered.mapInArrow(pack, BLOCK), "blocks")


def _load(row: dict, p: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row[f"{p}n"]
    return np.frombuffer(row[f"{p}ids"], "<i8"), np.frombuffer(row[f"{p}labels"], "<i8"), unpacked(row[f"{p}v"], row[f"{p}kind"], n)


def _tiles(pairs: DataFrame, anchors: DataFrame, cand: DataFrame, tasks: int) -> DataFrame:
    """Rows of (a, g): the anchor block first (c is null), then the candidate blocks of the group, dealt to tasks."""
    told = [c for c in anchors.columns if c not in ("no", "names")]
    left = pairs.select("a", "g").distinct().join(anchors.drop("names").withColumnRenamed("no", "a"), "a").select("a", "g", F.lit(None).cast("long").alias("c"), *told)
    missing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) if c not in cand.columns else F.col(c) for c in told]
    right = pairs.join(cand.drop("names").withColumnRenamed("no", "c"), "c").select("a", "g", "c", *missing)
    return left.union(right).repartition(tasks, "a", "g").sortWithinPartitions("a", "g", F.col("c").asc_nulls_first())


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, relabel_every: int | None = 7, labels: int = 10, positives: int = 5, negatives: int = 5, least_percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of vectors(vec_id, embedding, label).

    Components become floor(256 * x); a row's score is its integer inner product with the anchor; higher
    scores come first, ties by smaller vec_id. Anchors are the rows whose vec_id `anchor_every` divides;
    where `relabel_every` divides vec_id, the label first becomes (label + 1) % labels. An anchor's
    positives are its first other rows of the same label. Its negatives for a positive are the first rows of
    another label with least_percent * positive <= 100 * negative <= 100 * positive.

    Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take no
    part. Only vectors of one length are compared. Exact repeats of a row count once; rows that share a
    vec_id otherwise count each, but are no positives of one another. Scores beyond a long saturate. An
    anchor without positives, and a positive without negatives, gives no row; an empty table gives none.
    Other columns are ignored.

    All rows are compared with all anchors, in blocks: rows of a label lie in neighbouring blocks of about
    a megabyte, so positives are sought only in blocks that hold the anchors' labels. A task keeps the best
    of the blocks that it meets, so what is shuffled again is bounded by anchors x tasks.
    """
    spark = by_bytes(vectors.sparkSession)
    tasks = width(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    rows = rows.select(F.size("embedding").alias("d"), label.alias("label"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    chosen = rows.where(F.col("vec_id") % anchor_every == 0)
    count = chosen.count()
    anchors = _blocks(chosen, max(1, min(tasks, count // 64)), max(64, min(4 * BLOCK_ROWS, count // tasks + 1)))
    cand = _blocks(rows, tasks, block_rows)
    n_cand = cand.count()
    n_groups = max(1, -(-n_cand // GROUP), min(n_cand, 2 * tasks // max(1, anchors.count())))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(n_groups))

    # Positives: pairs of blocks that share a label.
    named = lambda b, n: b.select("d", F.col("no").alias(n), F.explode("names").alias("label"))
    near = named(anchors, "a").join(named(cand, "c"), ["d", "label"]).select("a", "c").distinct().withColumn("g", group("c"))

    def seek_positives(batches):
        now, best = None, None
        for row in rows_of(batches):
            if (row["a"], row["g"]) != now:
                if best:
                    yield from _positive_rows(now[0], best)
                now, (ids, names, v), best = (row["a"], row["g"]), _load(row, ""), None
                best = Best(len(ids), positives)
                continue
            c_ids, c_names, c_v = _load(row, "")
            for (i, s), score in _cells(v, c_v):
                r, c = np.nonzero((names[i : i + len(score), None] == c_names[None, s : s + score.shape[1]]) & (score >= best.score[i : i + len(score), -1:]))
                other = ids[i + r] != c_ids[s + c]
                r, c = r[other], c[other]
                best.add(i + r, score[r, c], c_ids[s + c])
        if best:
            yield from _positive_rows(now[0], best)

    tiles = _tiles(near, anchors, cand, tasks)
    found = tiles.mapInArrow(seek_positives, "a long, r int, score long, id long")
    order = Window.partitionBy("a", "r").orderBy(F.desc("score"), "id")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    lists = saved(found.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "k", "score", "id"))).alias("p")), "positives")  # at most a block's anchors x positives a row

    # Negatives: every candidate block but those whose only label is the anchors' only label.
    asking = anchors.join(lists.withColumnRenamed("a", "no"), "no")
    single = lambda b: F.when(F.size(b) == 1, F.get(b, F.lit(0)))
    all_pairs = asking.select("d", F.col("no").alias("a"), single("names").alias("la")).join(cand.select("d", F.col("no").alias("c"), single("names").alias("lc")), "d")
    all_pairs = all_pairs.where(~F.coalesce(F.col("la") == F.col("lc"), F.lit(False))).select("a", "c").withColumn("g", group("c"))

    def seek_negatives(batches):
        now, best = None, None
        for row in rows_of(batches):
            if (row["a"], row["g"]) != now:
                if best:
                    yield from _negative_rows(now[0], best, ids, p_score, p_id)
                now, (ids, names, v) = (row["a"], row["g"]), _load(row, "")
                p_score, p_id = np.full((len(ids), positives), NONE), np.full((len(ids), positives), LONG)
                for p in row["p"]:
                    p_score[p["r"], p["k"] - 1], p_id[p["r"], p["k"] - 1] = p["score"], p["id"]
                best = Best(len(ids) * positives, negatives)
                # least_percent * p <= 100 * n: n is at least the quotient, rounded up (Python's integers do not overflow).
                low = np.array([[max(-LONG, -(-least_percent * int(s) // 100)) if s > NONE else LONG for s in q] for q in p_score])
                continue
            c_ids, c_names, c_v = _load(row, "")
            for (i, s), score in _cells(v, c_v):
                z = i + len(score)
                high = p_score[i:z]
                free = names[i:z, None] != c_names[None, s : s + score.shape[1]]
                r, c = np.nonzero(free & (score >= low[i:z].min(1)[:, None]) & (score <= high.max(1)[:, None]))
                n = score[r, c]
                for k in range(positives):
                    fit = (n >= low[i + r, k]) & (n <= high[r, k]) & (high[r, k] > NONE)
                    best.add((i + r[fit]) * positives + k, n[fit], c_ids[s + c[fit]])
        if best:
            yield from _negative_rows(now[0], best, ids, p_score, p_id)

    tiles = _tiles(all_pairs, asking, cand, tasks)
    out = tiles.mapInArrow(seek_negatives, "a long, list long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    order = Window.partitionBy("a", "list").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _cells(v: np.ndarray, c: np.ndarray):
    """Scores in tiles of at most CELLS: ((first anchor, first candidate), scores)."""
    wide = min(len(c), 4096)
    high = max(1, CELLS // wide)
    for i in range(0, len(v), high):
        for s in range(0, len(c), wide):
            yield (i, s), products(v[i : i + high], c[s : s + wide])


def _positive_rows(a: int, best: Best):
    r, score, ids = best.rows()
    if len(r):
        yield pa.record_batch([pa.array(np.full(len(r), a)), pa.array(r.astype(np.int32)), pa.array(score), pa.array(ids)], names=["a", "r", "score", "id"])


def _negative_rows(a: int, best: Best, ids: np.ndarray, p_score: np.ndarray, p_id: np.ndarray):
    k = p_score.shape[1]
    lists, score, found = best.rows()
    if len(lists):
        yield pa.record_batch([pa.array(np.full(len(lists), a)), pa.array(lists), pa.array(ids[lists // k]), pa.array(p_id[lists // k, lists % k]), pa.array(p_score[lists // k, lists % k]), pa.array(score), pa.array(found)], names=["a", "list", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"])
