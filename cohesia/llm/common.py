"""Shared helpers: tables on the shared folder, word hashes of whole batches, components of sparse links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import scratch_path, tune

BATCH_BYTES = 1 << 20  # texts hashed together; bounds the temporaries of a task


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings, and small Arrow batches: a batch of long texts must fit beside others."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo `divisor`; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % F.lit(divisor)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns of sorted input; only one run is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        rows = list(zip(*[b.column(k).to_pylist() for k in range(keys)]))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first byte and end of every word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of the given texts."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    ends = heads[heads > 0] - 1
    last[ends] = inside[ends]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(a) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), a, z
    place = np.arange(len(raw)) - a[np.maximum(np.cumsum(first) - 1, 0)]
    size = int((z - a).max())
    powers = np.ones(size + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(size, 0x9E3779B97F4A7C15 | 1, np.uint64))
    terms = np.where(inside, _BYTE[raw] * powers[np.clip(place, 0, size)], np.uint64(0))
    return mix(np.add.reduceat(terms, a) + (z - a).astype(np.uint64)), np.searchsorted(offsets, a, "right") - 1, a, z


_STEP = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, in row order.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    raw, offsets = utf8(column)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        h, doc, _, _ = words(raw[offsets[i] : offsets[j]], at)
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        n = len(h) - k + 1
        wide = np.zeros(max(n, 0), np.uint64)
        for s in range(k if n > 0 else 0):
            wide += h[s : s + n] * _STEP[s]
        wide = mix(wide)
        for d in range(j - i):
            a, z = edge[d], edge[d + 1]
            if z - a >= k:
                yield np.unique(wide[a : z - k + 1])
            elif z > a:
                yield mix((h[a:z] * _STEP[: z - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(z - a))
            else:
                yield np.zeros(0, np.uint64)


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b), for ids that have a link to another.

    Large-star and small-star rounds: every node hands its smallest neighbour to the others, first to
    the larger ones, then to the smaller ones and itself. Minima are combined before the shuffle, a hub
    is only a hot key of a join with one row on the other side (which AQE splits), and each round is
    written to the shared folder. About log(n) rounds.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = saved(small.select("e.*").where("a <> b").distinct(), "links")
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        state = now
