"""Order-dependent work (ranks, running sums, quantiles) that never puts a large group in one task.

Groups with a bound at or below WINDOW_ROWS use a plain window. Anything larger is range
partitioned on (keys, order), so a group holding a third of all rows spreads over a third of
the partitions; per-partition totals (at most one row per key and partition) carry the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, width

WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


def _fits(df, keys, group_rows) -> bool:
    return (largest_group(df, keys) if group_rows is None else group_rows) <= WINDOW_ROWS


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Exclusive prefix sums within keys; `order` must break ties completely."""
    keys = list(keys)
    if _fits(df, keys, group_rows):
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()])
    spark = df.sparkSession
    ranged = df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
    ranged = ranged.repartitionByRange(max(width(spark), 2), *[F.col(k) for k in keys], *order)
    ranged = cut(ranged.withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy("__pid", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    by_part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_part = by_part.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__pid", *keys, *[F.coalesce(F.sum(f"__t_{n}").over(by_part), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    local = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)).alias(f"__l_{n}") for n in sums])
    out = out.join(offsets, ["__pid", *keys])
    return out.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 0, group_rows: int | None = None
) -> DataFrame:
    out = running_sums(df, keys, order, {name: F.lit(1).cast("long")}, group_rows)
    return out.withColumn(name, F.col(name) + F.lit(start)) if start else out


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], group_rows: int | None = None, weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per key as columns named by `probs`; nulls are skipped.

    A row stands for as many rows as its integer `weight` says.
    """
    keys = list(keys)
    times = F.lit(1) if weight is None else F.col(weight)
    df = df.where(F.col(value).isNotNull()).select(*keys, value, *([] if weight is None else [weight]))
    if _fits(df, keys, group_rows):
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p), times).alias(n) for n, p in probs.items()])
    counts = df.groupBy(*keys, value).agg(F.sum(times).alias("__c"))
    run = running_sums(counts, keys, [F.col(value)], {"__before": F.col("__c")})
    total = df.groupBy(*keys).agg(F.sum(times).alias("__n"))
    run = run.join(total, keys) if keys else run.crossJoin(total)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__before") <= at) & (at < F.col("__before") + F.col("__c"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__{name}_f"))
    cuts = run.groupBy(*keys).agg(*aggs)
    return cuts.select(
        *keys,
        *[
            (F.col(f"__{n}_lo") + F.col(f"__{n}_f") * (F.col(f"__{n}_hi") - F.col(f"__{n}_lo"))).alias(n)
            for n in probs
        ],
    )


def midranks(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column], group_rows=None) -> DataFrame:
    """One row per (keys, value): each weight's total there (`name`) and strictly below (`name_below`).

    Ties collapse before ordering, so a heavily tied value costs one row. The 1-based midrank of
    a member is `name_below + (name + 1) / 2`.
    """
    tied = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    return running_sums(tied, keys, [F.col(value)], {f"{n}_below": F.col(n) for n in weights}, group_rows)
