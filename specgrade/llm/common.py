"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from specgrade.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the ASCII blanks \x20 \x09-\x0D
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does just that on pure
    ASCII strings, and byte by byte; only other strings need ``translate``."""
    return (F.when(F.octet_length(c) == F.length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, UPPER.lower())))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that, beside doc_id, name a row: rows that agree on both hold
    the same text, so they share every per-row result."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def no_bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile get no runtime Bloom filters.  Spark takes what is
    cut for very large and adds them to its joins, three to a join on three
    columns; the driver then serialises their bits, a MB each, again and again
    with every later stage of the plan."""
    name = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_observed(df: DataFrame, **exprs: Column) -> tuple[DataFrame, dict]:
    """``cut`` and aggregates of its rows, taken in the same job."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in exprs.items()]))
    # a plan that Spark finds empty on the way may report nothing
    return out, seen.get or out.agg(*[c.alias(name) for name, c in exprs.items()]).first().asDict()


def gathered(df: DataFrame, rows: int, per_task: int = 1 << 16, least: int = 8) -> DataFrame:
    """``df``, which has about ``rows`` rows of a few longs, in no more
    partitions than that takes: every partition of a small table costs the
    driver the records of a task at each later step."""
    return df.coalesce(max(least, -(-rows // per_task)))


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if a count proves it has at most ``max_rows`` rows;
    else leave the join to Spark's own strategies."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written into the shared folder, from
    which later reads take only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batch, column: str = "text", max_bytes: int = 16 << 20):
    """An Arrow batch in slices of about ``max_bytes`` of a string or binary
    column, or one row."""
    import pyarrow.compute as pc
    size, start = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)
