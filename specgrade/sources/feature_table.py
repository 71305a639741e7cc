"""Content-addressed features.

A feature belongs to a text, not to a row: it is stored under the text's
SHA-256, so copies are computed once and a changed text never meets the
features of the old one.  Beside it a versioned map of row key to text hash
tells which rows are new, changed or unchanged since they were last seen.
Both are ledgers (``sources.ledger``) under a folder named by model and
parameters: an update that dies is done again without leaving anything twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.sources.corpus import feature_key
from specgrade.sources.ledger import BatchLedger, fingerprint

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


class FeatureTable:
    def __init__(self, spark: SparkSession, path: str, model: str, params: dict):
        self.spark = spark
        at = f"{path.rstrip('/')}/{feature_key(model, params, '')}"
        self.texts, self.rows = BatchLedger(spark, at + "/texts"), BatchLedger(spark, at + "/rows")

    def states(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, text_hash, state) of every row; a null text counts as empty."""
        now = df.select(F.col(key).alias("_key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash"))
        seen = self.rows.read()
        if seen is None:
            return now.select(F.col("_key").alias(key), "text_hash", F.lit(NEW).alias("state"))
        last = seen.groupBy("row_key").agg(F.max("version").alias("version"))
        held = seen.join(last, ["row_key", "version"]).select(F.col("row_key").alias("_key"), F.col("text_hash").alias("_held"))
        state = (F.when(F.col("_held").isNull(), NEW).when(F.col("_held") == F.col("text_hash"), UNCHANGED).otherwise(CHANGED))
        return now.join(held, "_key", "left").select(F.col("_key").alias(key), "text_hash", state.alias("state"))

    def update(self, df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
        """(key, text_hash, state, computed, features ...) of every row of
        ``df``, a stored table whose ``key`` names a row.  ``compute`` gets
        (text_hash, text), one row for each text that is not stored yet, and
        returns text_hash with the features; ``computed`` tells whose text was."""
        version = self.rows.commits().count() + 1
        states = self.states(df, key, text)
        todo = states.filter(F.col("state") != UNCHANGED)
        mark = fingerprint(todo, key, "text_hash").first()["fingerprint"]
        states = states.checkpoint()  # as of before this update
        todo = states.filter(F.col("state") != UNCHANGED)
        stored = self.texts.read()
        # one row of each text that no row has brought before
        one = todo.groupBy("text_hash").agg(F.min(key).alias(key))
        if stored is not None:
            one = one.join(stored.select("text_hash"), "text_hash", "left_anti")
        bring = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(one, key).select("text_hash", "text")
        name = f"{version}-{mark}"
        if not todo.isEmpty():
            if not self.texts.is_committed(name):  # else an update that died got this far
                self.texts.write(name, compute(bring))
            self.rows.write(name, todo.select(F.col(key).alias("row_key"), "text_hash", F.lit(version).cast("bigint").alias("version")))
        stored = self.texts.read()
        if stored is None:
            raise ValueError("no row and nothing stored: the features' columns are unknown")
        mine = stored.withColumn("computed", F.col("batch") == name).drop("batch")
        return states.join(mine, "text_hash").select(key, "text_hash", "state", (F.col("computed") & (F.col("state") != UNCHANGED)).alias("computed"),
                                                     *[c for c in mine.columns if c not in ("text_hash", "computed")])
