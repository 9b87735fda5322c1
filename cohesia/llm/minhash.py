"""Near-duplicate documents by one-permutation hashing, optimal densification, bands and star-shaped candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, mix, saved, shingles

BANDS, ROWS = 40, 6  # a pair at similarity 0.8 shares no band with probability 5e-6
BINS = BANDS * ROWS
TILE = 512  # documents compared at once in one task


def _donors(rounds: int = 2048) -> np.ndarray:
    """Row t, column i: the bin that an empty bin i asks in its t-th attempt, the same for all documents."""
    seed = np.arange(rounds * BINS, dtype=np.uint64) + np.uint64(77)
    return (mix(seed) % np.uint64(BINS)).astype(np.int16).reshape(rounds, BINS)


def signature(h: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """BINS minima of sorted hashes. A bin is a range of hash values, so its minimum is its first hash;
    an empty bin copies the first full bin that its own sequence of attempts meets."""
    edges = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS).clip(0, (1 << 64) - 1).astype(np.uint64)
    at = np.searchsorted(h, edges[:-1])
    full = at < np.append(at[1:], len(h))
    out = h[np.minimum(at, len(h) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        for t in range(0, len(donors), 256):
            asked = donors[t : t + 256, empty]
            met = full[asked]
            hit = met.any(0)
            first = met.argmax(0)
            out[empty[hit]] = out[asked[first[hit], np.flatnonzero(hit)]]
            empty = empty[~hit]
            if not len(empty):
                break
        out[empty] = h[0]
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and the band keys (empty for an empty set)."""

    def run(batches):
        donors = _donors()
        weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(9001, 9001 + BANDS, dtype=np.uint64))
        for b in batches:
            n, d1, d2, sig = [], [], [], []
            for h in shingles(b.column(1), k):
                n.append(len(h))
                d1.append(int((mix(h + np.uint64(11))).sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int((mix(h ^ np.uint64(0x5555555555555555)) * (h | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(h, donors) if len(h) else None)
            full = [s for s in sig if s is not None]
            keys = mix((np.array(full).reshape(len(full), BANDS, ROWS) * weights).sum(2, dtype=np.uint64) + salt).astype(np.int64) if full else np.zeros((0, BANDS), np.int64)
            lengths = np.array([0 if s is None else BANDS for s in sig], np.int32)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(keys.ravel()))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _labels(linked: np.ndarray) -> np.ndarray:
    lab = np.arange(len(linked))
    while True:
        new = np.where(linked, lab[None, :], len(lab)).min(1)
        new = np.minimum(new, lab)[np.minimum(new, lab)]
        if (new == lab).all():
            return lab
        lab = new


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have 100 * intersection >= percent * union, exactly, by products of membership columns."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    if m == 2:
        both = np.array([[n[0], 0], [0, n[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(m), n)
        count = np.bincount(column, minlength=len(values))
        place = np.full(len(values), -1)
        shared = np.flatnonzero(count > 1)
        place[shared] = np.arange(len(shared))
        column = place[column]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), np.float32)
        for c in range(0, len(shared), 8192):
            a, z = np.searchsorted(column, [c, c + 8192])
            part = np.zeros((m, min(8192, len(shared) - c)), np.float32)
            part[row[a:z], column[a:z] - c] = 1
            both += part @ part.T
        both = np.rint(both).astype(np.int64)
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, for every row of docs(doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles. Null,
    empty and blank texts have an empty set and no link; rows with equal sets (repeated rows too) collapse
    to their smallest doc_id before any comparison; other columns are ignored; an empty table gives no rows.

    Each set in a band's bucket has one candidate edge, to the bucket's smallest doc_id. Components of
    these stars hold every candidate pair and are compared exactly, on full sets, in tiles of at most
    about TILE documents a side; a large component has many tiles, in many tasks. A tile returns a
    spanning forest of its links, never its pairs.
    """
    drawn = saved(sketch(docs, k), "sketch")
    sets = drawn.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    sets = saved(sets, "sets")
    keyed = sets.select("rep", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.count("rep").alias("n")).where("n > 1").select("key", "head")
    stars = keyed.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = saved(components(stars), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("id") / TILE).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tiled = placed.hint("merge").join(text, "id")  # the same plan at every size
    tiled = tiled.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "id", "text")
    tiled = tiled.select("component", F.least("other", "block").alias("lo"), F.greatest("other", "block").alias("hi"), "id", "text")

    def verify(batches):
        for t in groups(batches, 3):
            ids = t.column("id").to_numpy()
            if len(ids) < 2:
                continue
            column = t.column("text").combine_chunks()
            lab = _labels(_linked(list(shingles(column, k)), percent))
            own = np.flatnonzero(lab != np.arange(len(lab)))
            if len(own):
                yield pa.record_batch([pa.array(ids[own], pa.int64()), pa.array(ids[lab[own]], pa.int64())], names=["a", "b"])

    links = tiled.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(verify, "a long, b long")
    found = components(links)
    reps = sets.select("d1", "d2", "n_shingles", "rep").join(found, F.col("rep") == F.col("id"), "left")
    reps = reps.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles", "d1", "d2").join(reps, ["d1", "d2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; of rows with equal doc_id and text one stays.

    A row without doc_id stays unless its text repeats such a row.
    """
    keep = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    rows = docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
    return rows.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")
