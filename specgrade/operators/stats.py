"""Result statistics (A5-A8, A10-A12, A17): one aggregation pass each.

Global aggregates use only mergeable partial aggregates (count/sum/min/max/
stddev) plus exact ``percentile``, whose state is a map of distinct values:
for satisfaction rates (k/t with t the list length) that map is bounded by
the distinct fractions, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: token price used for cost estimates (per 1000 tokens)
TOKEN_PRICE_PER_1K = 0.0015


def describe_rate(df: DataFrame, rate: str = "satisfaction_rate", group: list[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Count, mean, min, max, sample stddev and the quartiles
    (exact, linear interpolation like pandas) of a rate column.

    Exact quartiles keep one counter per distinct value; for rates k/t that
    is small.  ``approx=True`` switches to a fixed-size sketch
    (percentile_approx) for continuous columns with unbounded distinct values.
    """
    r = F.col(rate)
    if approx:
        aggs = [F.count(r).alias("n"), F.avg(r).alias("mean_rate"), F.min(r).alias("min_rate"),
                F.max(r).alias("max_rate"), F.stddev_samp(r).alias("std_rate")]
        aggs += [F.percentile_approx(r, q, 10000).cast("double").alias(f"p{int(q * 100)}_rate")
                 for q in (0.25, 0.5, 0.75)]
        return df.groupBy(*(group or [])).agg(*aggs)
    aggs = [F.count(r).alias("n"), F.avg(r).alias("mean_rate"), F.min(r).alias("min_rate"),
            F.max(r).alias("max_rate"), F.stddev_samp(r).alias("std_rate"),
            F.percentile(r, F.lit(0.25)).alias("p25_rate"), F.percentile(r, F.lit(0.5)).alias("p50_rate"),
            F.percentile(r, F.lit(0.75)).alias("p75_rate")]
    return df.groupBy(*(group or [])).agg(*aggs)


def share_yes(verdicts: DataFrame, by: str = "idx") -> DataFrame:
    """Share of 'Yes' verdicts and count per constraint position."""
    return verdicts.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                                    F.avg((F.col("verdict") == "Yes").cast("double")).alias("yes_share"))


def merge_summary(merged: DataFrame) -> DataFrame:
    """Successes (merged_length > 0), mean merged length, total tokens."""
    return merged.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.count_if(F.col("merged_length") > 0).alias("n_success"),
                      F.avg("merged_length").alias("mean_merged_length"),
                      F.sum("tokens_used").cast("bigint").alias("total_tokens"))


def compression_summary(df: DataFrame, target_pct: float = 0.25) -> DataFrame:
    """A10: mean compression ratio vs. the target percentage."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("compression_ratio").alias("mean_ratio"),
                  F.lit(float(target_pct)).alias("target_ratio"),
                  (F.avg("compression_ratio") - F.lit(float(target_pct))).alias("ratio_gap"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Tokens per provider plus the grand total (provider null), one rollup."""
    return usage.rollup("provider").agg(F.sum("tokens").cast("bigint").alias("tokens"),
                                        F.count(F.lit(1)).alias("calls"))


def usage_cost(rolled: DataFrame, price_per_1k: float = TOKEN_PRICE_PER_1K) -> DataFrame:
    """cost = tokens x price / 1000."""
    return rolled.withColumn("cost", F.col("tokens").cast("double") * F.lit(price_per_1k) / F.lit(1000.0))


def win_rate(df: DataFrame, categories=("grammar", "coherence", "likability", "overall")) -> DataFrame:
    """Share of wins of the *first* source article per category (after
    A16 un-swapping) and the parse-failure rate."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.avg(F.col("needs_parsing").cast("double")).alias("parse_failure_rate")]
    for c in categories:
        aggs.append(F.avg(F.when(F.col("needs_parsing") == 0,
                                 (F.col(f"{c}_winner") == "first").cast("double"))).alias(f"{c}_first_win_rate"))
    return df.agg(*aggs)


def total_constraints(df: DataFrame, constraints: str = "constraints") -> Column:
    """A3: ``subset_size`` when the column exists, else the T4 line count."""
    from specgrade.functions.lists import count_numbered
    if "subset_size" in df.columns:
        return F.col("subset_size").cast("bigint")
    return count_numbered(constraints)
