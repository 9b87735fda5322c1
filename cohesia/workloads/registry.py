"""Named queries and their oracle SQL, filled by the query modules on import."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Oracle columns that come out as 32-bit integers.
SMALL_INTS = {
    "c05_smallest_eigpairs": ("idx",), "c05_smallest_eigpairs_surface": ("idx",), "g13_tag_fractions": ("tag",), "g26_knn": ("rank",),
    "g30_face_adjacency": ("t1", "t2"), "f12_sample_dw": ("draw",), "f28_resolution_change": ("target",), "t16_calibration": ("bin",),
    "t02_design_matrix": ("y",), "t04_group_folds": ("fold",), "t05_shuffled_folds": ("fold",), "t06_oof_logistic": ("fold",), "t26_ladder": ("rung",),
    "t46_dry_run": ("perm",), "t18_torus_null_nodes": ("draw",), "s02_vtk_binary": ("tag",), "s03_read_carp": ("tag",), "s07_subject_id": ("id",),
    "s11_build_sharded": ("shard",), "s13_relabel": ("y",),
}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so results compare across engines by type too."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(c).cast(wide[t]).alias(c) if t in wide else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            return _plain(fn(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    import importlib

    import cohesia
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(cohesia)  # executors need no copy of the package

    for m in ("queries_mesh", "queries_graph", "queries_fragility", "queries_statistics", "queries_models", "queries_localise", "queries_traces", "queries_files"):
        importlib.import_module(f"cohesia.workloads.{m}")
    for name, cols in SMALL_INTS.items():
        casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
        ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLES[name]})"
