"""Compare registered queries with their oracle SQL in DuckDB.

python tests/oracle.py [name-part ...]   checks the queries whose names match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DEFAULT_DIR = os.environ.get("TRACELAKE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return f"{value:.6g}" if abs(value) >= 1e6 else f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple(str(x) for x in t))


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def compare(spark, con, sf_dir, name, build, sql) -> tuple[str, int, str]:
    """(verdict, rows, detail)"""
    df = build(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(got), ""
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return "COLUMNS", len(got), f"{names} vs {want_names}"
    off = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if KIND.get(t, t) != types[n]]
    if got != want:
        only_spark = [r for r in got if r not in set(want)][:2]
        only_sql = [r for r in want if r not in set(got)][:2]
        return "VALUES", len(got), f"{len(want)} expected; spark {only_spark} sql {only_sql}"
    return ("ok" if not off else "TYPES"), len(got), " ".join(off)


def main(parts: list[str]) -> int:
    from tracelake.plans import registry
    from tracelake.session import build_session

    registry.load_all()
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(DEFAULT_DIR)
    bad = 0
    for name, build in registry.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            verdict, n, detail = compare(spark, con, DEFAULT_DIR, name, build, registry.ORACLES.get(name))
        except Exception as error:  # report every failing query, not only the first
            verdict, n, detail = "ERROR", 0, str(error)[:600]
        bad += verdict not in ("ok", "rows-only")
        print(f"{verdict:9} {n:7d} {time.time() - start:6.1f}s {name} {detail}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
