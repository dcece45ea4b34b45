"""Compare registered queries with their SQL by value: python tests/check_oracles.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """(rows, message); message is empty when both sides agree."""
    start = time.time()
    frame = fn(spark, sf_dir)
    got = frame.collect()
    spent = time.time() - start
    if sql is None:
        return len(got), "" if got else "no rows", spent
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(frame.columns):
        return len(got), f"columns {sorted(frame.columns)} against {sorted(columns)}", spent
    mine, theirs = rows_of(frame.columns, got), rows_of(columns, result.fetchall())
    if not mine:
        return 0, "no rows", spent
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(mine)][:2]
        return len(mine), f"{len(mine)} against {len(theirs)}; only Spark {extra}; only SQL {missing}", spent
    return len(mine), "", spent


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            n, message, spent = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            n, message, spent = 0, f"{type(error).__name__}: {str(error)[:700]}", 0
        bad += bool(message)
        print(f"## {'OK ' if not message else 'BAD'} {name} rows={n} {spent:.1f}s {'sql' if name in sqls else 'rows'} {message}", flush=True)
    print(f"## {bad} bad")


if __name__ == "__main__":
    main()
