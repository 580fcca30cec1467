"""Compare registered queries with their SQL twins in DuckDB.

``python tests/compare.py [folder] [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            if value != value:
                return "nan"
            return float(f"{value:.9g}") + 0.0
        return value

    return sorted(
        (tuple(plain(record[i]) for i in order) for record in records), key=repr
    )


def compare(spark, folder, name, make, sql):
    started = time.time()
    frame = make(spark, folder)
    got = [tuple(row) for row in frame.collect()]
    took = time.time() - started
    if sql is None:
        return took, len(got), None
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    cursor = connection.execute(sql)
    columns = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return took, len(got), f"columns {sorted(frame.columns)} != {sorted(columns)}"
    left, right = rows_of(frame.columns, got), rows_of(columns, expected)
    if left != right:
        differing = [pair for pair in zip(left, right) if pair[0] != pair[1]][:3]
        return took, len(got), f"{len(left)} vs {len(right)} rows; {differing}"
    kinds = [[type(v).__name__ for v in rows[0]] if rows else [] for rows in (left, right)]
    if kinds[0] != kinds[1]:
        return took, len(got), f"types {kinds}"
    return took, len(got), ""


def session(cpus="8"):
    from pyspark.sql import SparkSession

    from assayframe import tuned

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = tuned(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, twins, failed = session(), oracle_sql(), 0
    for name, make in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            took, count, problem = compare(spark, folder, name, make, twins.get(name))
        except Exception as error:  # report and go on with the next query
            took, count, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:1500]}"
        verdict = "rows only" if problem is None else (problem or "ok")
        failed += bool(problem)
        print(f"{name:24s} {took:6.2f}s {count:7d} {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]) > 0)
