"""Run the registered queries against DuckDB and report differences.

    python -m checks.compare [folder] [query ...]
"""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLE, QUERIES


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ontime checks")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{folder}/{file}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, folder: str, name: str) -> str | None:
    """None if both engines agree, otherwise what differs first."""
    made = QUERIES[name](spark, folder)
    ours = _rows(made.columns, [tuple(row) for row in made.collect()])
    result = con.sql(ORACLE[name])
    theirs = _rows(result.columns, result.fetchall())
    if sorted(made.columns) != sorted(result.columns):
        return f"columns {sorted(made.columns)} against {sorted(result.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for our, their in zip(ours, theirs):
        if our != their or [type(x) for x in our] != [type(x) for x in their]:
            return f"{our} against {their}"
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    for name in names:
        start = time.time()
        if name in ORACLE:
            found = difference(spark, con, folder, name) or "same"
        else:
            rows = QUERIES[name](spark, folder).collect()
            found = f"{len(rows)} rows, no SQL: {rows[:3]}"
        print(f"{name}: {found[:600]} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
