"""Exactly-once sinks of micro-batches.

An epoch's rows are one batch of a ledger (``sources.ledger``), written under
its number and then committed.  Spark repeats an epoch that died; the ledger
then replaces it, so every epoch's rows are there once, and readers see
committed epochs only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.sources.ledger import BatchLedger


def epoch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits each epoch under ``path``."""
    def sink(batch: DataFrame, epoch: int) -> None:
        BatchLedger(batch.sparkSession, path).write(str(epoch), batch)
    return sink


def read_epochs(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows with their ``epoch``; None while there is none."""
    rows = BatchLedger(spark, path).read()
    return None if rows is None else rows.withColumn("epoch", F.col("batch").cast("long")).drop("batch")


def latest_epoch(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last committed epoch, with its number."""
    ledger = BatchLedger(spark, path)
    last = ledger.commits().agg(F.max(F.col("batch").cast("long")).alias("epoch")).first()["epoch"]
    return None if last is None else ledger.read_batch(str(last)).withColumn("epoch", F.lit(last))
