"""Run registered queries against their DuckDB oracles and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple((v is not None, v or "") for v in r))


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(left, right, shown=3):
    """None if equal, else a short text."""
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}; first {left[1][:1]} vs {right[1][:1]}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(left[1])} rows differ; " + "; ".join(f"{a} vs {b}" for a, b in bad[:shown])
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = session()
    if os.environ.get("TASK_ROWS"):
        spark.conf.set("tidemark.task.rows", os.environ["TASK_ROWS"])
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = spark_table(query(spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS {name} {len(got[1])} {took:.1f}s e.g. {got[1][:1]}", flush=True)
                continue
            diff = difference(got, duck_table(con, oracles[name]))
        except Exception as exc:  # noqa: BLE001
            took, diff = time.time() - start, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {len(got[1]) if diff is None else ''} {took:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
