"""Run queries by name and compare them with their SQL: ``python -m workload.check SF_DIR [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.7g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.7g}"
    if isinstance(value, int):
        return f"{float(value):.7g}" if abs(value) < 1e6 else str(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, function, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = function(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = f"spark {time.time() - start:.2f}s, {len(got)} rows"
    if sql is None:
        return True, f"{took}, no SQL"
    relation = con.sql(sql)
    if sorted(relation.columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    want = rows_of(relation.columns, relation.fetchall())
    if got == want:
        return True, took
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} / {len(want)} rows\n   spark {only_got}\n   sql   {only_want}"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    from workload.catalog import ORACLE, QUERIES

    spark, con, bad = session(), connect(sf_dir), []
    for name in names or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))
        except Exception as error:  # noqa: BLE001 - reported, and the run goes on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += [] if ok else [name]
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
