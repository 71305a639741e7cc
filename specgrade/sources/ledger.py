"""Tables written batch by batch, each batch committed on its own.

A batch is written under its name (``data/batch=<name>``, replacing what an
unfinished attempt left there) and then committed (``commits/batch=<name>``).
Readers see committed batches only, so a writer that dies between batches
leaves whole batches behind, and doing a batch again replaces it: every
batch's rows are in the table once, whatever crashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.sources.corpus import read_if_written

COMMITS = "n_rows long, batch string"


class BatchLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(n_rows, batch) of the committed batches."""
        # batch names stay strings whatever they look like
        found = read_if_written(self.spark, f"{self.path}/commits", schema=COMMITS)
        return self.spark.createDataFrame([], COMMITS) if found is None else found

    def write(self, batch: str, rows: DataFrame) -> None:
        """Write a batch and commit it; done again, it replaces itself."""
        at = f"{self.path}/data/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        self.commit(batch, self.spark.read.parquet(at).count())

    def commit(self, batch: str, n_rows: int) -> None:
        (self.spark.createDataFrame([(n_rows,)], "n_rows long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}"))

    def is_committed(self, batch: str) -> bool:
        return not self.commits().filter(F.col("batch") == batch).isEmpty()

    def read(self, wanted: Callable[[str], bool] = lambda name: True) -> DataFrame | None:
        """Rows of the committed batches whose name is ``wanted``, with their
        ``batch``; None while there is none."""
        # by their paths: an unfinished batch may be replaced while this is read
        names = [r["batch"] for r in self.commits().select("batch").collect() if wanted(r["batch"])]  # one per batch
        if not names:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={n}" for n in names])
        return rows.withColumn("batch", F.col("batch").cast("string"))

    def read_batch(self, batch: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/batch={batch}")


def fingerprint(df: DataFrame, *cols: str, by: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """Order-free digest of the rows' ``cols`` as an aggregate (over ``by``
    groups): the number of rows and two sums of 64-bit hashes, so those of
    parts add up to that of the whole."""
    def total(salt: int):
        return F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(38,0)"))
    made = F.concat_ws("-", F.count(F.lit(1)).cast("string"), *(F.lpad(F.hex(_low64(total(s))), 16, "0") for s in (1, 2)))
    return (df.groupBy(*by) if by else df).agg(made.alias(out))


def _low64(total):
    """The low 63 bits of a sum, 0 for none."""
    return F.coalesce(F.pmod(total, F.lit("9223372036854775808").cast("decimal(38,0)")).cast("bigint"), F.lit(0).cast("bigint"))
