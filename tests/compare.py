"""Run queries on Spark and DuckDB and report differences.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or (
            df[c].dtype == object and len(df) and hasattr(df[c].dropna().iloc[0] if df[c].notna().any() else "", "year")
        ):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df, relation) -> str | None:
    """None when both results agree in columns, types, rows and values."""
    left, right = spark_df.toPandas(), relation.df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN"}
    ours = {n: kinds.get(t, t) for n, t in spark_df.dtypes}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        return "types " + str({n: (ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]})
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    left, right = tidy(left), tidy(right)
    for c in left.columns:
        a, b = left[c], right[c]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(a)} values differ in {c}: {a[i]!r} != {b[i]!r}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, todo, sql, failed = duck(sf_dir), queries(), oracle_sql(), 0
    print("no query for", sorted(set(sql) - set(todo)), flush=True)
    for name in names or todo:
        begin = time.time()
        try:
            df = todo[name](spark, sf_dir)
            problem = difference(df, con.sql(sql[name])) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {time.time() - begin:6.1f}s {name} {problem or ''}", flush=True)
    print(failed, "failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
