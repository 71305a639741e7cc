"""Structured Streaming twins of the batch operators.

Both are incremental versions of a batch query over files arriving in a
directory; with ``trigger(availableNow=True)`` a run processes everything
present and stops, and the checkpoint makes a rerun pick up only new
files.  Results must equal the batch query over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.functions.text import char_length, normalize_text
from specgrade.operators.corpus import corpus_kept, parse_corpus
from specgrade.sources.corpus import CORPUS_SCHEMA
from specgrade.sources.usage_log import parse_usage
from specgrade.streaming.sink import epoch_sink, latest_epoch, read_epochs


def usage_totals_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                        max_files_per_trigger: int | None = None):
    """Running token totals per provider over an append-only usage-log
    directory.  The aggregation state is kept by the checkpoint; every
    micro-batch commits the totals as of its epoch (``streaming.sink``), so a
    reader has whole totals at any time (``read_usage_totals``), also while or
    after an epoch dies.  Returns the started query (call
    ``awaitTermination``)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    usage = parse_usage(reader.load(in_dir))
    totals = usage.groupBy("provider").agg(F.sum("tokens").cast("bigint").alias("tokens"),
                                           F.count(F.lit(1)).alias("calls"))
    return (totals.writeStream.outputMode("complete").foreachBatch(epoch_sink(out_dir))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_usage_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals of the last complete epoch: (provider, tokens, calls)."""
    found = latest_epoch(spark, out_dir)
    if found is None:
        return spark.createDataFrame([], "provider string, tokens bigint, calls bigint")
    return found.drop("epoch")


def _corpus_lines(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The dumps' lines as a stream, each with its file; a malformed line has
    its text in ``_corrupt_record``."""
    reader = (spark.readStream.schema(CORPUS_SCHEMA).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(in_dir).select("*", F.col("metadata.url").alias("url"), F.col("_metadata.file_path").alias("file"))


def classify_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                    min_len: int = 0, max_len: int | None = None):
    """the corpus filter (F10) on JSON-lines files as they arrive;
    stateless, appended to Parquet with exactly-once file-sink semantics.
    ``classify_stream_quarantine`` keeps the malformed lines as well."""
    raw = _corpus_lines(spark, in_dir)
    rows = raw.filter(F.col("_corrupt_record").isNull()).select("id", "text", "created", "added", "source", "url")
    out = parse_corpus(rows, min_len, max_len)
    return (out.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def classify_stream_quarantine(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, min_len: int = 0,
                               max_len: int | None = None, max_files_per_trigger: int | None = None):
    """F18 with S1's quarantine: one stream, one parse, two results.  Kept
    rows and malformed lines (``line``, with their file) are written together,
    so an epoch commits both or neither; read them with ``read_classified``
    and ``read_quarantine``."""
    raw = _corpus_lines(spark, in_dir, max_files_per_trigger).withColumnRenamed("_corrupt_record", "line")
    bad = F.col("line").isNotNull()
    normalized = normalize_text("text")
    # the columns of parse_corpus, its conditions, and the malformed lines
    rows = raw.filter(bad | corpus_kept(min_len, max_len)).select(
        "id", "url", "source", "created", "added", F.when(~bad, normalized).alias("text"),
        F.when(~bad, char_length(normalized)).alias("text_length"), "line", "file")
    return (rows.writeStream.outputMode("append").foreachBatch(epoch_sink(out_dir))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_classified(spark: SparkSession, out_dir: str) -> DataFrame | None:
    rows = read_epochs(spark, out_dir)
    return None if rows is None else rows.filter("line IS NULL").drop("line")


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame | None:
    rows = read_epochs(spark, out_dir)
    return None if rows is None else rows.filter("line IS NOT NULL").select("file", "line", "epoch")
