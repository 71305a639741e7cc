"""Usage logs (S6, S7): delimiter-separated text lines parsed as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_usage_line(value="value") -> Column:
    """S6: 'yyyy-MM-dd HH:mm:ss | provider | model | tokens[ | metadata]' ->
    struct; lines with fewer than 4 fields or non-integer tokens -> null."""
    v = F.col(value) if isinstance(value, str) else value
    parts = F.split(v, r" \| ")
    ok = F.size(parts) >= 4
    tokens = F.get(parts, 3).try_cast("bigint")
    return F.when(ok & tokens.isNotNull(), F.struct(
        F.try_to_timestamp(F.get(parts, 0), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.get(parts, 1).alias("provider"), F.get(parts, 2).alias("model"), tokens.alias("tokens"),
        F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), " | ")).alias("metadata")))


def parse_usage(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select(parse_usage_line(value).alias("u")).filter(F.col("u").isNotNull()).select("u.*")


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only usage log as a table."""
    return parse_usage(spark.read.text(path))


def parse_legacy_line(value="value") -> Column:
    """S7: 'MM-dd-yyyy HH:mm:ss : tokens' (exactly two fields on ' : ')."""
    v = F.col(value) if isinstance(value, str) else value
    parts = F.split(v, " : ")
    tokens = F.get(parts, 1).try_cast("bigint")
    return F.when((F.size(parts) == 2) & tokens.isNotNull(), F.struct(
        F.try_to_timestamp(F.get(parts, 0), F.lit("MM-dd-yyyy HH:mm:ss")).alias("ts"), tokens.alias("tokens")))


def read_legacy_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_legacy_line("value").alias("u")).filter(
        F.col("u").isNotNull()).select("u.*")


def usage_lines(events: DataFrame) -> DataFrame:
    """Render usage lines from an event table: provider = event_type,
    model = 'model-' + user_id % 3, tokens = floor(value); every second
    event carries its props as the metadata field."""
    base = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"),
                       F.concat(F.lit("model-"), F.pmod(F.col("user_id"), F.lit(3)).cast("string")),
                       F.floor("value").cast("bigint").cast("string"))
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" | ", base, F.col("props"))).otherwise(base)
    return events.select(line.alias("value"))


def legacy_lines(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws(" : ", F.date_format("ts", "MM-dd-yyyy HH:mm:ss"),
                                     F.floor("value").cast("bigint").cast("string")).alias("value"))
