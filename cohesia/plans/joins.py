"""Equi-joins that keep hot keys out of a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROWS = 200_000


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], target: int = TARGET_ROWS) -> DataFrame:
    """Inner bucket join: a bucket's left rows split into ceil(count/target) salts, right rows copied to each.

    `spread` names left columns whose hash picks the salt. Exact for any distribution.
    """
    load = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(target)).cast("int").alias("__salts"))
    lhs = left.join(load, list(on)).withColumn("__salt", F.pmod(F.xxhash64(*spread), F.col("__salts")).cast("int"))
    rhs = right.join(load, list(on)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    return lhs.drop("__salts").join(rhs.drop("__salts"), [*on, "__salt"]).drop("__salt")


def endpoints(edges: DataFrame, nodes: DataFrame, cols: Sequence[str], src="src", dst="dst", how="inner") -> DataFrame:
    """Attach node columns to both ends of an edge table as `<col>_s` and `<col>_d`."""
    a = nodes.select("graph_id", F.col("node_id").alias(src), *[F.col(c).alias(f"{c}_s") for c in cols])
    b = nodes.select("graph_id", F.col("node_id").alias(dst), *[F.col(c).alias(f"{c}_d") for c in cols])
    return edges.join(a, ["graph_id", src], how).join(b, ["graph_id", dst], how)


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
