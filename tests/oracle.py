"""Compare registered queries with their SQL in DuckDB on the same files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        return value.item()
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype))
        for c in got.columns
        if len(got)
        and got[c].dtype.kind != want[c].dtype.kind
        and not (got[c].dtype.kind in "OM" and want[c].dtype.kind in "OM")
        and not (got[c].isna().any() and {got[c].dtype.kind, want[c].dtype.kind} == {"f", "i"})  # integers with nulls
    ]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    if kinds:
        return f"types {kinds}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    patterns = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            got = build(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracle:
                verdict = "rows only" if len(got) else "EMPTY"
            else:
                begin = time.time()
                want = con.execute(oracle[name]).df()
                verdict = compare(got, want) or ("ok" if len(got) else "EMPTY")
                took = (took, time.time() - begin)
            shown = f"{took:.1f}s" if isinstance(took, float) else f"{took[0]:.1f}s/{took[1]:.1f}s"
        except Exception as error:  # reported per query, the run goes on
            verdict, shown, got = f"ERROR {type(error).__name__}: {str(error)[:600]}", "-", []
        if verdict not in ("ok", "rows only"):
            failed += 1
        print(f"{name:32s} {len(got):8d} {shown:>12s}  {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
