"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return "~" if v is None else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """An empty string, or what differs; two empty results prove nothing and differ too."""
    df = query(spark, sf_dir)
    got = canonical(df.collect(), df.columns)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = canonical(cur.fetchall(), columns)
    if not got and not want:
        return "both are empty"
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; only Spark: {a}; only SQL: {b}"[:1500]


if __name__ == "__main__":
    import os
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = sys.argv[1]
    con, queries, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [*queries]:
        began = time.time()
        try:
            why = compare(spark, con, sf_dir, queries[name], sql[name]) if name in sql else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{name}: {why or 'ok'} ({time.time() - began:.1f} s)", flush=True)
