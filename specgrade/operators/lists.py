"""List-shaped operators: explode to normal form, bucket expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.functions.lists import number_items, parse_numbered

# fixed value: the study's default constraint-bucket sizes
DEFAULT_SIZES = [7, 15, 23, 31, 39]


def parse_sizes(spec: str) -> list[int]:
    """'7,15,23' -> [7, 15, 23] (CLI form of the bucket sizes)."""
    return [int(x) for x in spec.split(",") if x.strip()]


def explode_constraints(df: DataFrame, key: str, text: str = "constraints",
                        items: str | None = None) -> DataFrame:
    """One row per (key, idx, constraint), idx 1-based.  ``items`` names an
    already-parsed array column; otherwise ``text`` is parsed with T1."""
    arr = F.col(items) if items else parse_numbered(text)
    return df.select(key, F.posexplode(arr).alias("pos", "constraint")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("idx"), "constraint")


def expand_buckets(df: DataFrame, text: str = "constraints", sizes=None,
                   items: str | None = None) -> DataFrame:
    """Every input row x every bucket size; first min(size, total) items
    renumbered in ``selected_constraints``, ``subset_size`` = min(size, total).

    A generator over a literal array (5 rows per input row, no join), so the
    expansion is narrow: no shuffle, partitioning preserved.
    """
    sizes = DEFAULT_SIZES if sizes is None else (parse_sizes(sizes) if isinstance(sizes, str) else sizes)
    arr = F.col(items) if items else parse_numbered(text)
    out = (df.withColumn("_sg_items", arr)
             .withColumn("_sg_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))))
    return (out.withColumn("selected_constraints", number_items(F.slice("_sg_items", 1, F.col("_sg_size"))))
               .withColumn("subset_size", F.least(F.col("_sg_size"), F.size("_sg_items")).cast("int"))
               .drop("_sg_items", "_sg_size"))


def bucket_counts(expanded: DataFrame, sizes=None) -> DataFrame:
    """Rows whose subset_size equals each *requested* size (clipped rows
    are attributed to a size only when equal), plus the expansion factor
    inputs.  One aggregation pass with a conditional count per size."""
    sizes = DEFAULT_SIZES if sizes is None else sizes
    counts = expanded.agg(*[F.count_if(F.col("subset_size") == s).alias(f"n_{s}") for s in sizes],
                          F.count(F.lit(1)).alias("n_rows"))
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(s).cast("int").alias("size"), F.col(f"n_{s}").alias("n_rows")) for s in sizes
    ])).alias("s")).select("s.size", "s.n_rows")


def legacy_expand(df: DataFrame, sizes=None) -> DataFrame:
    """The notebook form on column ``Constraint`` (same result as T12)."""
    return expand_buckets(df, text="Constraint", sizes=sizes)


def expansion_factor(inp: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows in, rows out and the out/in ratio of a bucket expansion
    (one aggregate plus a scalar subquery, a single row)."""
    rows_out = expanded.select(F.count(F.lit(1))).scalar()
    return (inp.agg(F.count(F.lit(1)).alias("rows_in"))
               .withColumn("rows_out", rows_out)
               .withColumn("expansion_factor", F.when(F.col("rows_in") > 0, F.col("rows_out") / F.col("rows_in"))
                           .otherwise(F.lit(0.0))))
