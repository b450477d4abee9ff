"""Run queries() against oracle_sql() the way the driver does, locally.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from demoforge.session import TABLES, local_session  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, repr(type(x).__name__) if x is not None else "", x if not isinstance(x, tuple) else repr(x)) for x in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: repr(r))


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_SPARK_KIND = {"LongType": "int64", "IntegerType": "int32", "ShortType": "int16", "ByteType": "int8",
               "DoubleType": "float64", "FloatType": "float32", "StringType": "string", "BooleanType": "bool"}
_DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
              "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "HUGEINT": "int128"}


def spark_kinds(df):
    return {f.name: _SPARK_KIND.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}


def duck_kinds(cur):
    return {d[0]: _DUCK_KIND.get(str(d[1]), str(d[1])) for d in cur.description}


def check(spark, con, sf_dir, name, qfn, sql, verbose=True):
    t0 = time.time()
    df = qfn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    sk, dk = spark_kinds(df), duck_kinds(cur)
    type_diff = {c: (sk[c], dk.get(c)) for c in sk if sk[c] != dk.get(c)}
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    if sc != dc:
        res["status"] = f"COLUMNS {sc} vs {dc}"
    elif [repr(r) for r in sr] != [repr(r) for r in dr]:
        diff = [r for r in sr if r not in set(dr)][:3]
        diff2 = [r for r in dr if r not in set(sr)][:3]
        res["status"] = "VALUES"
        if verbose:
            res["spark_only"] = [str(x)[:300] for x in diff]
            res["duck_only"] = [str(x)[:300] for x in diff2]
    elif type_diff:
        res["status"] = f"TYPES {type_diff}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    spark = local_session()
    for kv in os.environ.get("ORACLE_CONF", "").split(","):
        if "=" in kv:
            k, v = kv.split("=", 1)
            spark.conf.set(k, v)
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            r = check(spark, con, sf_dir, name, qs[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED", bad, "of", len(names or qs))


if __name__ == "__main__":
    main(sys.argv[1:])
