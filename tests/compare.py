"""Run a Spark query and its DuckDB oracle on the same files and compare values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.2f}s (no sql)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    msg = f"rows={len(got)} spark={t1 - t0:.2f}s duck={t2 - t1:.2f}s"
    if sorted(names) != cols:
        return False, f"{msg} columns {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rows]
    types = dict(df.select(*cols).dtypes)
    duck = {d[0]: str(d[1]) for d in cur.description}
    a = sorted(tuple(map(_norm, r)) for r in got)
    b = sorted(tuple(map(_norm, r)) for r in want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return False, f"{msg} rowcount {len(a)} != {len(b)} {extra}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{msg} {len(diff)} rows differ; cols={cols} first: {str(diff[0])[:1500]}"
    clash = []
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in cols:
        if types[c] not in pairs or pairs[types[c]] != duck[c]:
            clash.append(f"{c}: {types[c]} / {duck[c]}")
    if not got:
        msg += " EMPTY"
    if clash:
        msg += " TYPES " + "; ".join(clash)
    return not clash, msg


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from coursewright.session import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    only = sys.argv[2:]
    spark = build_session(cpus="8")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for key in sorted(set(oracles) - set(queries)):
        print("ORACLE WITHOUT QUERY", key)
    bad = 0
    total = time.time()
    for name, query in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, msg = compare(spark, con, name, query, oracles.get(name), sf)
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("bad", bad, f"total {time.time() - total:.1f}s")


if __name__ == "__main__":
    main()
