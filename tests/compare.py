"""Run registered queries on Spark and their check SQL on DuckDB and compare the tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("n", 0.0 if v == 0 else float(f"{v:.9g}")) if not math.isnan(v) else ("", "nan")
    if isinstance(v, int):
        return ("n", float(v))
    return ("s", str(v))


def diff(df, con, sql: str) -> str | None:
    """None when equal, otherwise the first difference."""
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} vs {sorted(names)}"
    order_a = [cols.index(c) for c in sorted(cols)]
    order_b = [names.index(c) for c in sorted(cols)]
    a = sorted(tuple(_norm(r[i]) for i in order_a) for r in got)
    b = sorted(tuple(_norm(r[i]) for i in order_b) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; only spark {list(set(a) - set(b))[:2]}; only sql {list(set(b) - set(a))[:2]}"
    bad = 0
    for x, y in zip(a, b):
        if x != y and not all(
            p == q or (p[0] == q[0] == "n" and math.isclose(p[1], q[1], rel_tol=1e-7, abs_tol=1e-9))
            for p, q in zip(x, y)
        ):
            bad += 1
            first = (x, y) if bad == 1 else first  # noqa: F821
    if bad:
        return f"{bad}/{len(a)} rows differ; columns {sorted(cols)}; e.g. {first[0]} vs {first[1]}"
    for i, c in enumerate(sorted(cols)):
        ta = {type(r[order_a[i]]) for r in got} - {type(None)}
        tb = {type(r[order_b[i]]) for r in want} - {type(None)}
        if ta and tb and ta != tb:
            return f"types of {c}: {ta} vs {tb}"
    return None


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as entry

    from terrasig.session import build

    spark = build()
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        picked = [n for n in queries if n == name or (name.endswith("*") and n.startswith(name[:-1]))]
        for q in picked:
            t = time.time()
            try:
                df = queries[q](spark, sf_dir)
                if q in checks:
                    t1 = time.time()
                    con.execute(checks[q]).fetchall()
                    t2 = time.time()
                    out = diff(df, con, checks[q])
                    note = f"sql {t2 - t1:.1f}s"
                    n = len(con.execute(checks[q]).fetchall()) if not out else 0
                else:
                    n, out, note = df.count(), None, "rows only"
                state = "ok  " if out is None and n else ("EMPTY" if out is None else "FAIL")
                print(f"{state} {q} {n} rows {time.time() - t:.1f}s {note} {out or ''}"[:900], flush=True)
                failed += state != "ok  "
            except Exception as e:  # noqa: BLE001
                failed += 1
                print(f"ERR  {q} {type(e).__name__} {str(e)[:700]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
