"""Runs a catalogue query on Spark and its SQL on DuckDB and compares the results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(e) for e in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(e)) for k, e in v.items()))
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    total = sum(got.values())
    if sql is None:
        return True, f"{name}: rows-only {total} rows, {t1 - t0:.1f}s"
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    bad = [(c, t, kinds[c]) for c, t in df.dtypes if t in loose and loose[t] != kinds[c]]
    extra, missing = got - want, want - got
    ok = not extra and not missing and not bad
    note = f"{name}: {'ok' if ok else 'MISMATCH'} {total} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if not ok:
        note += f"\n  types {bad}\n  spark only ({sum(extra.values())}) {list(extra)[:3]}"
        note += f"\n  duck only ({sum(missing.values())}) {list(missing)[:3]}\n  cols {sorted(names)}"
    return ok, note


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from inkloom.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    failed = []
    for q in entry.queries():
        if not wanted or any(q == w or q.startswith(w + "_") for w in wanted):
            try:
                good, text = compare(session, q, f"/root/testdata/{sf}")
            except Exception as exc:  # report and go on with the next query
                good, text = False, f"{q}: ERROR {type(exc).__name__} {str(exc)[:1500]}"
            print(text, flush=True)
            if not good:
                failed.append(q)
    print("failed:", failed)
