"""Runs registered queries against DuckDB on the same tables.

    python tests/oracle.py [folder] [name part ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    got = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} vs {len(want[1])}; only spark {len(a - b)} {sorted(a - b)[:2]}; "
                f"only sql {len(b - a)} {sorted(b - a)[:2]}")
    return ""


def types_differ(df, con, sql):
    """Column classes (number, text, ..) that do not agree."""
    def cls(t):
        t = t.lower()
        for name, words in (("int", ("int", "long", "hugeint")), ("float", ("double", "float", "decimal")), ("text", ("string", "varchar"))):
            if any(t.startswith(w) for w in words) and "[" not in t:
                return name
        return t.split("(")[0].split("<")[0]
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {k: (mine[k], theirs.get(k)) for k in mine if cls(mine[k]) != cls(theirs.get(k, "?"))}


def main():
    import __spark_entry__ as e
    from guidemill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                td = types_differ(df, con, sqls[name])
                n = df.count() if diff else ""
            else:
                diff, td, n = "", "", f"rows only {df.count()}"
            bad += bool(diff)
            print(f"{'FAIL' if diff else 'ok  '} {name:42s} {time.time() - t:6.1f}s {n} {diff[:900]} {td or ''}", flush=True)
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name:42s} {time.time() - t:6.1f}s {type(ex).__name__} {str(ex)[:900]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
