"""Run registered queries next to their oracle SQL and compare row for row."""

from __future__ import annotations

import glob
import os
import signal
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind in "iu":
            pdf[c] = pdf[c].astype("int64")
        elif pdf[c].dtype.kind == "O":
            pdf[c] = pdf[c].map(lambda v: v.tolist() if hasattr(v, "tolist") else v)
    key = pdf.astype(str)
    return pdf.loc[key.sort_values(list(key.columns)).index].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = _norm(got), _norm(want)
    kinds = [(c, a[c].dtype.kind, b[c].dtype.kind) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind and len(a) and not (a[c].isna().all() or b[c].isna().all())]
    if kinds:
        return f"types {kinds}"
    sa, sb = a.astype(str), b.astype(str)
    if not sa.equals(sb):
        bad = (sa != sb).any(axis=1)
        i = bad.idxmax()
        return f"{int(bad.sum())}/{len(a)} rows differ, first: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def _late(*_):
    raise TimeoutError('query limit')


def run(spark, names=None, sf_dir="/root/testdata/sf0.01"):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry

    signal.signal(signal.SIGALRM, _late)
    con = connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        t = time.time()
        signal.alarm(int(os.environ.get('QUERY_LIMIT', '120')))
        try:
            got = fn(spark, sf_dir).toPandas()
            dt = time.time() - t
            if name in sql:
                t = time.time()
                want = con.execute(sql[name]).df()
                diff = difference(got, want)
                tag = "OK  " if diff is None else "DIFF"
                note = f"oracle {time.time() - t:.1f}s" + ("" if diff is None else f"  {diff}")
            else:
                tag, note = "ROWS", str(got.head(2).to_dict("records"))[:200]
        except Exception as e:  # noqa: BLE001
            tag, dt, note = "FAIL", time.time() - t, f"{type(e).__name__}: {str(e)[:600]}"
        signal.alarm(0)
        bad += tag in ("DIFF", "FAIL")
        print(f"{tag} {name} {dt:.1f}s rows={len(got) if tag in ('OK  ', 'ROWS', 'DIFF') else '-'} {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    sys.exit(1 if run(spark, sys.argv[1:], sf) else 0)
