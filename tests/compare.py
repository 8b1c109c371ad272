"""Run registered queries and their SQL side by side.

    python tests/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return f"decimal {value}"
    return f"{type(value).__name__} {value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, run, sql, sf_dir):
    """Empty text if both sides agree, else what differs."""
    df = run(spark, sf_dir)
    left_columns, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_columns, right = _rows([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}", len(left)
    if left == right:
        return "", len(left)
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return f"rows {len(left)} vs {len(right)}\n   spark {only_left}\n   sql   {only_right}", len(left)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        started = time.time()
        try:
            problem, n = differences(
                spark, con, entry.queries()[name], entry.oracle_sql()[name], sf
            )
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {n} rows {time.time() - started:.2f}s {problem}", flush=True)
    print("bad:", bad, "of", len(names))
