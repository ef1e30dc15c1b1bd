"""Runs queries against their SQL twins: `python tests/oracle.py [name ...]` (sf dir in ORACLE_SF_DIR)."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ("", "")
    if isinstance(x, bool):
        return ("b", x)
    return (type(x).__name__, str(x) if not isinstance(x, (int, float)) else x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, number of rows)"""
    df = fn(spark, sf_dir)
    theirs = con.sql(sql)
    ours_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in df.schema.fields}
    their_types = dict(zip(theirs.columns, map(str, theirs.types)))
    if ours_types != their_types:
        return f"schema {sorted(ours_types.items())} vs {sorted(their_types.items())}", 0
    a = _rows(df.columns, df.collect())
    b = _rows(theirs.columns, theirs.fetchall())
    if a != b:
        sa, sb = set(a), set(b)
        return (f"{len(a)} vs {len(b)} rows ({sorted(df.columns)}); only ours {sorted(sa - sb, key=repr)[:3]} "
                f"only theirs {sorted(sb - sa, key=repr)[:3]}"), len(a)
    return None, len(a)


def main() -> int:
    import __spark_entry__ as entry
    from featloom.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problem, n = None, queries[name](spark, sf_dir).count()
        except Exception as e:
            problem, n = "".join(traceback.format_exception_only(e))[:700], 0
        bad += problem is not None or n == 0
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s", problem or "", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
