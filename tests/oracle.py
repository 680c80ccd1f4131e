"""Run registered queries against their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(rows, order):
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; nothing if they are equal."""
    names = sorted(df.columns)
    spark_rows = _rows(df.collect(), [df.columns.index(n) for n in names])
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    if sorted(sql_names) != names:
        return [f"columns {names} and {sorted(sql_names)}"]
    sql_rows = _rows(cursor.fetchall(), [sql_names.index(n) for n in names])
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = dict(df.dtypes)
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    found = [
        f"type of {n}: {spark_types[n]} and {types[n]}" for n in names if same.get(spark_types[n]) != types[n]
    ]
    if len(spark_rows) != len(sql_rows):
        found.append(f"{len(spark_rows)} and {len(sql_rows)} rows")
    if spark_rows != sql_rows:
        pair = next(((a, b) for a, b in zip(spark_rows, sql_rows) if a != b), None)
        found.append(f"values differ, first: {pair}"[:1500])
    return found


if __name__ == "__main__":
    import __spark_entry__ as entry
    from bibflow.runtime import drop_scratch, session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session("oracle", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = database(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            result = differences(df, con, sql[name]) if name in sql else ["no SQL"]
            rows = df.count()
        except Exception as error:  # report and go on with the next query
            result, rows = [f"{type(error).__name__}: {error}"[:1500]], None
        print(f"{'ok  ' if not result else 'FAIL'} {name} {rows} {time.time() - start:.1f}s {result or ''}", flush=True)
    drop_scratch(spark)
