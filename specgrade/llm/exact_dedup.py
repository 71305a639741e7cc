"""Exact dedup with a heavy-hitter split.

Every row becomes (doc_id, SHA-256 of its text with A-Z lower-cased).
Misra-Gries summaries, one per partition, name the digests that may hold more
than 1/counters of all rows; an exact count verifies them.  The winners are
fewer than ``counters``, so they are broadcast and their rows are settled map
side.  All other digests are grouped and joined by an ordinary shuffle, in
which no digest holds more than 1/counters of the rows.

Defined results: null text counts as empty; empty texts equal each other.
Of equal texts the row with the largest doc_id stays (null is the smallest);
of rows that repeat doc_id and text exactly one stays.  An empty table gives
no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import ascii_lower, cut, whole_text

LEAST = -(1 << 63)


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries summary of one partition: at most ``counters`` digests,
    each with a count too low by at most rows / (counters + 1)."""
    held: dict[bytes, int] = {}
    for batch in batches:
        found = pc.value_counts(batch.column(0))
        for digest, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            less = sorted(held.values(), reverse=True)[counters]
            held = {d: n - less for d, n in held.items() if n > less}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})


def exact_dedup(docs: DataFrame, counters: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.unhex(F.sha2(ascii_lower(whole_text()), 256))
    rows = cut(docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("rid")))
    total = rows.count()
    summaries = rows.select("digest").mapInArrow(partial(misra_gries, counters=counters), "digest binary, n long")
    # a digest with over 2/counters of all rows is among the largest sums
    likely = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")

    def grouped(df: DataFrame) -> DataFrame:
        order = F.coalesce("doc_id", F.lit(LEAST))
        return df.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max_by("rid", order).alias("keep_rid"))

    winners = cut(grouped(rows.join(F.broadcast(likely), "digest")).filter(F.col("group_size") * counters > total))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    settled = heavy.unionByName(rest.join(grouped(rest), "digest"))
    return settled.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
