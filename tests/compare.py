"""Run a query on Spark and its SQL on DuckDB over the same tables and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(_value(x) for x in v.values())
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)):
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    left_cols, left = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols, right = rows([c[0] for c in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        in_l, in_r = set(left), set(right)
        only_l = [r for r in left if r not in in_r][:2]
        only_r = [r for r in right if r not in in_l][:2]
        return f"{len(bad)} of {len(left)} rows differ, e.g. {only_l} vs {only_r}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cohortlens.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, queries[name], sql[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
            state = "ok" if problem is None else f"FAIL {problem}"
        except Exception as error:  # noqa: BLE001
            state = f"ERROR {str(error)[:600]}"
        kind = "sql" if name in sql else "rows"
        print(f"{name:34s} {kind:4s} {time.time() - start:6.2f}s {state[:900]}", flush=True)
