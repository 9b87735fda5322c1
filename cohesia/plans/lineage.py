"""Session settings and lineage control shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on: hot join keys are split by AQE even when a
# downstream aggregation shares the key, and small shuffles are merged after the fact, up to a few MB:
# columns of ids and counts shrink so much in a shuffle that 64 MB of them fill gigabytes of a task.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

FIRST_PARTS = 200


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    # There must be parts to merge: what one task holds is then a matter of the size of a part, not of the table's.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(FIRST_PARTS, width(spark))))
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime SQL settings for a block of eager work; the caller's come back afterwards."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only for an unconfigured local session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table written mid-job."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise on the shared folder so loops keep a short plan and survive executor loss.

    Without constraints: a checkpoint keeps those of its plan, and a union of checkpoints whose constraints name
    columns of that plan which are no output of it cannot be planned ("key not found").
    """
    shared_dir(df.sparkSession)
    with settings(df.sparkSession, {"spark.sql.constraintPropagation.enabled": "false"}):
        return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


TASK_ROWS = 1_000_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of `rows` rows: the session's number, more where a task would hold over TASK_ROWS."""
    return max(width(spark), -(-rows // TASK_ROWS))
