"""Side-by-side run of the registered queries and their SQL oracles (as the driver does)."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) or isinstance(b, bool) or isinstance(a, str):
        return a == b and type(a) is type(b)
    return a == b


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    df = fn(spark, sf)
    cols = sorted(df.columns)
    left = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {sorted(set(names) ^ set(cols))}"
    at = [names.index(c) for c in cols]
    right = [tuple(norm(r[i]) for i in at) for r in res.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r)
    left.sort(key=key)
    right.sort(key=key)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if not all(map(same, a, b))]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if not same(x, y)]
        return f"{len(bad)}/{len(left)} differ, first {diff} in {a[:4]}"
    return None if left else "EMPTY"


def main(argv):
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from tracewell.session import local_session

    sf = "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duck(sf)
    sqls, qs = oracle_sql(), queries()
    names = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                err = compare(spark, con, qs[n], sqls[n], sf)
            else:
                rows = qs[n](spark, sf).collect()
                err = None if rows else "EMPTY"
                err = err or None
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:600]}"
        failed += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in sqls else '(rows)'} {err or ''}", flush=True)
    print("failed", failed, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
