"""Order-insensitive comparison of a Spark result with a DuckDB oracle
(row count, column names, values rounded to 6 dp) — the local twin of the
driver's correctness gate."""

from __future__ import annotations

import math
from decimal import Decimal


DIGITS = 6


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (round(v, DIGITS) if DIGITS is not None else v) + 0.0
    if isinstance(v, Decimal):
        return (round(float(v), DIGITS) if DIGITS is not None else float(v)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark_df, duck_con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = duck_con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    sc, sr = canonical(s_cols, s_rows)
    dc, dr = canonical(d_cols, d_rows)
    info = {"spark_rows": len(sr), "oracle_rows": len(dr), "cols_match": sc == dc,
            "values_match": sr == dr}
    if sc != dc:
        info["spark_cols"], info["oracle_cols"] = sc, dc
    elif sr != dr:
        sset, dset = set(sr), set(dr)
        info["only_spark"] = [r for r in sr if r not in dset][:3]
        info["only_oracle"] = [r for r in dr if r not in sset][:3]
    return info


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
