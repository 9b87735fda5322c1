"""Outcome tables, input listing, caches, shards, reconciliation and the metrics sink."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted rhythm outcomes; fixed values.
OUTCOMES = ("NR", "AF", "AFL")


def read_outcomes(spark: SparkSession, path: str, subject: str = "Patient_ID", outcome: str = "Recurrence_Rhythm_2yr") -> DataFrame:
    """(subject, outcome) with a leading byte-order mark ignored; unknown labels raise when read."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    v = F.upper(F.trim(outcome))
    return raw.select(F.trim(subject).alias("subject"), F.when(v.isin(*OUTCOMES), v).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(v, F.lit("NULL"))))).alias("outcome"))


def subject_id(name: Column) -> Column:
    """Number after ID in a file name, leading zeros dropped; NULL when absent."""
    return F.nullif(F.regexp_extract(name, r"ID0*(\d+)", 1), F.lit("")).cast("int")


def require_rows(df: DataFrame, hint: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"no usable rows: {hint}")
    return df


def list_inputs(spark: SparkSession, path: str, limit: int | None = None, pattern: str | None = None, hint: str = "", nested: bool = False) -> DataFrame:
    """(path, length) ordered by size then path, with those of inner folders if `nested`; contents are never read. A missing or empty source raises with the hint."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    try:
        files = r.load(path).select("path", "length")
        require_rows(files, hint or path)
    except AnalysisException as e:
        raise FileNotFoundError(f"missing source {path}: {hint}") from e
    out = files.orderBy("length", "path")
    return out.limit(limit) if limit is not None else out


def config_key(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def with_cache(todo: DataFrame, root: str, config: dict, fn: Callable[[DataFrame], DataFrame], key: str = "subject") -> DataFrame:
    """Records for every subject of `todo`, computing only those the config's cache lacks."""
    path = f"{root.rstrip('/')}/{config_key(config)}"
    have = _existing(todo.sparkSession, path)
    missing = todo if have is None else todo.join(have.select(key).distinct(), key, "left_anti")
    if missing.limit(1).count():
        fn(missing).write.mode("append").parquet(path)
    return todo.sparkSession.read.parquet(path).join(todo.select(key).distinct(), key, "left_semi")


def build_sharded(items: DataFrame, index: str, size: int, fn: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Process items by shard = index // size, skipping shards already written; appends are committed whole."""
    tagged = items.withColumn("shard", F.floor(F.col(index) / size).cast("int"))
    have = _existing(items.sparkSession, out)
    if have is not None:
        tagged = tagged.join(have.select("shard").distinct(), "shard", "left_anti")
    if tagged.limit(1).count():
        fn(tagged).write.partitionBy("shard").mode("append").parquet(out)
    return items.sparkSession.read.parquet(out)


def _finite(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, x: _finite(x, t.valueType))
    return c


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL at any depth."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_metrics(df: DataFrame, path: str) -> None:
    sanitise(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def relabel(records: DataFrame, labels: DataFrame, key: str = "subject", outcome: str = "y") -> DataFrame:
    """Records with the outcome replaced; a subject without a verdict raises."""
    if records.join(labels, key, "left_anti").limit(1).count():
        raise ValueError("a subject has no verdict")
    return records.drop(outcome).join(labels.select(key, outcome), key)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids present on one side only."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
    return left.union(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def union_cohorts(parts: dict[str, DataFrame], pooled: str = "combined") -> DataFrame:
    """All cohorts by name plus a pooled copy, so one grouping serves every cohort and the pool."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("cohort", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("cohort", F.explode(F.array("cohort", F.lit(pooled))))
