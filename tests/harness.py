"""Compare queries with their SQL: python tests/harness.py sf_dir [name prefix ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _cell(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x)).lower()
    if hasattr(x, "dtype") and x.dtype.kind == "f" or isinstance(x, float):
        return f"{float(x) + 0.0:.9g}"
    if hasattr(x, "tolist") and not hasattr(x, "isoformat") or isinstance(x, (list, tuple)):
        v = x.tolist() if hasattr(x, "tolist") else list(x)
        return "[" + ",".join(map(_cell, v)) + "]" if isinstance(v, list) else _cell(v)
    return str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def compare(spark, c, sf: str, query, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"rows {len(got)} and {len(want)}; {odd}"
    kinds = dict(df.dtypes)
    sql_kinds = {d[0]: str(d[1]) for d in c.execute(sql).description}
    bad = {k: (kinds[k], sql_kinds[k]) for k in kinds if (kinds[k] in ("double", "float")) != (sql_kinds[k] in ("DOUBLE", "FLOAT", "NUMBER")) and "DECIMAL" not in sql_kinds[k]}
    return f"types {bad}" if bad and len(got) else "" if got or not want else ""


def session():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


if __name__ == "__main__":
    import __spark_entry__ as e

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = session(), connect(sf)
    sqls = e.oracle_sql()
    for name, f in e.queries().items():
        if prefixes and not name.startswith(prefixes) or not prefixes and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, f, sqls[name]) if name in sqls else f"no SQL, {f(spark, sf).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        if said or "-v" in prefixes:
            print(name, "|", said[:900], "|", round(time.time() - t, 1), flush=True)
    print("done")
