"""A slice of the registered queries against their oracle SQL on the small tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import connect, difference

D = "/root/testdata/sf0.01"
SLICE = ["g03_edge_weights", "g25_radius_graph", "c06_fiedler", "c12_activation_multi", "f11_sfi_features", "t11_delong", "t13_auc_ci", "t34_concordance", "r8_detuning", "s02_vtk_binary"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SLICE)
def test_query(spark, name):
    got = entry.queries()[name](spark, D).toPandas()
    assert difference(got, connect(D).execute(entry.oracle_sql()[name]).df()) is None


def test_entry_without_the_llm_folders(tmp_path):
    """The other queries register whether the pipeline's file stays or goes with the two folders."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "cohesia"), tmp_path / "cohesia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    told = []
    for _ in range(2):
        told.append(subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120).stdout.split())
        shutil.copy(os.path.join(root, "corpus_pipeline.py"), tmp_path) if os.path.exists(os.path.join(root, "corpus_pipeline.py")) else None
    own = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]
    assert told[0] == told[1] and int(told[0][0]) == len(own)
