"""Run registered queries against their SQL: python -m checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, text):
    cursor = con.execute(text)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def difference(spark_side, duck_side) -> str | None:
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} != {duck_side[0]}"
    if len(spark_side[1]) != len(duck_side[1]):
        return f"row count {len(spark_side[1])} != {len(duck_side[1])}"
    for a, b in zip(spark_side[1], duck_side[1]):
        if a != b:
            return f"first difference\n  spark {a}\n  sql   {b}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shortlist")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    from checks import ORACLES, QUERIES

    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            mine = spark_rows(QUERIES[name](spark, sf_dir))
            took = time.time() - started
            if name not in ORACLES:
                print(f"ROWS {name} {len(mine[1])} spark {took:.1f}s", flush=True)
                continue
            started = time.time()
            found = difference(mine, duck_rows(con, ORACLES[name]))
            verdict = "OK  " if found is None else "DIFF"
            bad += found is not None
            print(f"{verdict} {name} {len(mine[1])} spark {took:.1f}s sql {time.time() - started:.1f}s {found or ''}"[:1500], flush=True)
        except Exception as err:  # report and go on to the next query
            bad += 1
            print(f"FAIL {name} {str(err)[:1200]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
