"""Run registered queries against their DuckDB SQL: row count, column names, values.

Values are compared order-insensitively; doubles are compared after rounding to 6
decimals (every registered query rounds its scores to 6 decimals already).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    res["values_match"] = a == b
    if not res["values_match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = list(sa - sb)[:3]
        res["only_oracle"] = list(sb - sa)[:3]
        res["n_diff"] = len(sa ^ sb)
    return res


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tomescope.session import get_spark

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_spark()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    ok = True
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            df = fn(spark, sf)
            print({"name": name, "rows_only": df.count()}, flush=True)
            continue
        try:
            r = compare(spark, name, fn, sqls[name], sf, con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:800]}
        good = r.get("cols_match") and r.get("values_match") and r.get("spark_rows") == r.get("oracle_rows")
        ok = ok and bool(good)
        print(("PASS " if good else "FAIL ") + str(r), flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
