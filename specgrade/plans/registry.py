"""Query registry: every registered query is a (spark, sf_dir) -> DataFrame
callable over the driver's parquet tables, with an optional DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


# Doubles whose last bits depend on summation order (averages, deviations,
# norms, dot products) are presented rounded to this many decimals, in the
# Spark result and in the oracle alike, so two engines agree bit for bit.
ROUND_DIGITS = 9


def query(name: str, sql: str | None = None, round_cols: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run = fn
        if round_cols:
            def run(spark, sf_dir, _fn=fn):
                from pyspark.sql import functions as F
                df = _fn(spark, sf_dir)
                return df.withColumns({c: F.round(F.col(c), ROUND_DIGITS) for c in round_cols})
            run.__doc__ = fn.__doc__
            run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if round_cols:
                rep = ", ".join(f"round({c}, {ROUND_DIGITS}) AS {c}" for c in round_cols)
                body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n)"
            ORACLE[name] = body
        return run
    return deco
