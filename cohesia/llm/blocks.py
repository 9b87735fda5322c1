"""Blocks of vectors: many rows of a table in one row of bytes, and tasks that meet pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 64 << 20  # of an Arrow batch: a block is a row, so rows alone do not bound it


def by_bytes(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def usable(column: str) -> Column:
    """True for a vector that is not null, not empty and has only finite components."""
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of an array column that all have `d` components, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def fresh(ids: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Mask of rows, sorted by all of the given arrays, that do not repeat the row before."""
    keep = np.ones(len(ids), bool)
    if len(ids) > 1:
        same = ids[1:] == ids[:-1]
        for o in others:
            same &= (o[1:] == o[:-1]).reshape(len(ids) - 1, -1).all(1)
        keep[1:] = ~same
    return keep


def packed(v: np.ndarray) -> tuple[bytes, str]:
    """Bytes of a matrix in the smallest of three types that holds it exactly, and the type."""
    for kind in ("<i2", "<f4"):
        low = np.iinfo(kind) if kind == "<i2" else np.finfo(kind)
        if not v.size or (np.abs(v).max() <= float(low.max)) and (v.astype(kind) == v).all():
            return v.astype(kind).tobytes(), kind
    return v.astype("<f8").tobytes(), "<f8"


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def pieces(batches: Iterator[pa.RecordBatch], key: str, limit) -> Iterator[pa.Table]:
    """Sorted input in runs of one `key` and at most limit(key) rows; only one run is held."""
    held: list[pa.RecordBatch] = []
    have, now = 0, None
    for b in batches:
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        i = 0
        while i < b.num_rows:
            if keys[i] != now:
                if held:
                    yield pa.Table.from_batches(held)
                held, have, now = [], 0, keys[i]
            n = min(int(np.searchsorted(keys[i:], now, "right")), limit(now) - have)
            held.append(b.slice(i, n))
            have, i = have + n, i + n
            if have == limit(now):
                yield pa.Table.from_batches(held)
                held, have, now = [], 0, None
    if held:
        yield pa.Table.from_batches(held)


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of equal keys together, sorted by the keys, in n partitions."""
    return df.repartition(max(1, n), *keys).sortWithinPartitions(*keys)
