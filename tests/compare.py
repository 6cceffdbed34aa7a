"""Run registered queries against their SQL statements in DuckDB.

Usage: python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    """Empty string when equal, otherwise what differs."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(set(spark_cols) ^ set(duck_cols))}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    si, di = ([cols.index(c) for c in sorted(spark_cols)] for cols in (spark_cols, duck_cols))
    a = sorted([tuple(_cell(r[i]) for i in si) for r in spark_rows])
    b = sorted([tuple(_cell(r[i]) for i in di) for r in duck_rows])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return ""
    x, y = bad[0]
    names = sorted(spark_cols)
    diff = [f"{n}: {p} vs {q}" for n, p, q in zip(names, x, y) if p != q]
    return f"{len(bad)} of {len(a)} rows differ; first {x[:3]}: {diff[:4]}"


def types_of(df, duck_desc):
    """Column types that differ in family (number, text, time, truth)."""
    def family(t):
        t = t.lower()
        if any(k in t for k in ("int", "hugeint")) and "interval" not in t:
            return "int"
        if any(k in t for k in ("double", "float", "decimal")):
            return "float" if "decimal" not in t else "decimal"
        if "bool" in t:
            return "bool"
        if "timestamp" in t:
            return "time"
        if "date" in t:
            return "date"
        return "text"

    duck = {d[0]: str(d[1]) for d in duck_desc}
    return [f"{f.name}:{f.dataType.simpleString()}/{duck[f.name]}" for f in df.schema.fields
            if family(f.dataType.simpleString()) != family(duck.get(f.name, ""))]


def main(argv):
    from marketframe.session import build_session

    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    sqls = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in sqls:
                start = time.time()
                res = con.execute(sqls[name])
                desc = res.description
                want = res.fetchall()
                duck_took = time.time() - start
                verdict = compare(rows, df.columns, want, [d[0] for d in desc])
                kinds = types_of(df, desc) if not verdict else []
                if kinds:
                    verdict = f"types {kinds}"
            else:
                verdict, duck_took = ("" if rows else "no rows"), float("nan")
        except Exception as exc:  # report and go on with the next query
            verdict, took, duck_took, rows = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - start, 0, []
        print(f"{'ok  ' if not verdict else 'FAIL'} {name:45s} rows={len(rows):6d} spark={took:5.2f}s duck={duck_took:5.2f}s {verdict}", flush=True)
        if verdict:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
