"""Text files as numbered lines, scanned in splits: no file has to pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def numbered_lines(spark: SparkSession, path: str, stem: Column | None = None) -> DataFrame:
    """(graph_id, line_no, line): 0-based position in the file, or across the ordered part files of a stem.

    A split reads its rows in file order, so the position inside a split is the row id minus the
    split's first id; split sizes (one row per split) give the offsets. The scan is written out
    first because both steps must see the same splits. `stem` maps _path to the graph id.
    """
    stem = F.regexp_extract("_path", r"([^/]+?)(\.[^./]*)?$", 1) if stem is None else stem
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")
    )
    raw = cut(raw.withColumn("graph_id", stem))
    part = raw.groupBy("graph_id", "_path", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("graph_id").orderBy("_path", "_at").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("graph_id", "_path", "_at", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(part, ["graph_id", "_path", "_at"]).select("graph_id", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")
