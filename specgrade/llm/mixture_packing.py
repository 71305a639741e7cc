"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenized, closed with an end id and queued by source.  Every
window of ``size`` tokens takes from each queue its target share, within a
token; deficits are carried across windows and partitions (:mod:`mixture_plan`).
By default the targets are the sources' own shares, so all queues run dry
together.  Documents are cut where a queue's share of a window ends, and no
sequence is padded: what no whole window holds goes into sequences of powers
of two.

A document's place follows from the tokens that its queue holds before it:
the tokens before it in its task (found while encoding) plus a running total
over tasks.  Only (task, source) totals are shuffled; the ids stay in the table
written by the encoder.  ``max_queues`` bounds the queues: sources with less
than that part of all tokens share one queue, in which they stand in the
order of the tasks.

Defined results: null text counts as empty and packs as the end id alone, null
source as the source ''.  Repeated rows are packed each on its own.  An empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgrade.llm.common import broadcast_if, slices, whole_text, written
from specgrade.llm.encoding import VOCABULARY, byte_bpe, vocabulary_bytes
from specgrade.llm.mixture_plan import Plan, places, plan

# what a batch of pieces may hold
BATCH_TOKENS = 1 << 21


def encoded(docs: DataFrame, end_id: int, vocabulary: str) -> DataFrame:
    """(part, doc_id, source, before, n, ids) a document: its tokens and, of
    the documents of its source in its task, the tokens before it."""
    kind = "<u2" if max(end_id, len(vocabulary_bytes(vocabulary))) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = byte_bpe(vocabulary), {}
        for batch in (part for whole in batches for part in slices(whole)):
            before, ids = [], []
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist()):
                ids.append(np.array([*encode(text), end_id], dtype=kind))
                before.append(held.get(source, 0))
                held[source] = before[-1] + len(ids[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("source"), pa.array(before, pa.int64()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "doc_id", "source", "before", "n", "ids"])
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), whole_text().alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, source string, before long, n long, ids binary")


def queues(totals: DataFrame, max_queues: int) -> tuple[list[str], int]:
    """The sources that have a queue of their own, each with at least
    1/max_queues of all tokens, and the tokens of all others, which are none
    or at least as many."""
    total = totals.agg(F.sum("n")).first()[0] or 0
    own = totals.filter(F.col("n").cast("decimal(38,0)") * max_queues >= F.lit(total).cast("decimal(38,0)")).collect()  # at most max_queues rows
    own = sorted((r.n, r.source) for r in own)
    others = total - sum(n for n, _ in own)
    if own and 0 < others * max_queues < total:  # too few for a queue: the smallest joins them
        others += own.pop(0)[0]
    return sorted(s for _, s in own), others


def _weights(sources: list[str | None], tokens: list[int], targets: dict[str, float] | None, size: int) -> list[int]:
    """Whole-numbered weights: the tokens themselves, or where targets are
    given the target of a source, else its own share."""
    if targets is None:
        return tokens
    total = sum(tokens)
    wanted = [float(targets.get(s, n / total)) if s is not None else n / total for s, n in zip(sources, tokens)]
    if any(w * size < sum(wanted) for w in wanted):
        raise ValueError("a target is less than one token of a window")
    return [max(-(-(1 << 30) // size), round(w / sum(wanted) * (1 << 30))) for w in wanted]


def mixture(docs: DataFrame, size: int = 2048, end_id: int = 1, vocabulary: str = VOCABULARY, targets: dict[str, float] | None = None,
            max_queues: int = 64, broadcast_rows: int = 200_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source; ``with_ids`` adds the piece's ids."""
    rows = written(encoded(docs, end_id, vocabulary), "mixture")
    parts = written(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "mixture-parts")
    own, others = queues(parts.groupBy("source").agg(F.sum("n").alias("n")), max(1, min(max_queues, size)))
    number = F.coalesce(F.array_position(F.array(*map(F.lit, own)), F.col("source")), F.lit(0)) if own else F.lit(0)
    # queues are numbered from 1 by source; 0 is the shared one
    parts = parts.withColumn("queue", number.cast("int"))
    held = {r.queue: r.n for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    numbers = sorted(held)
    sources = [own[q - 1] if q else None for q in numbers]
    tokens = [held[q] for q in numbers]
    p = plan(tokens, _weights(sources, tokens, targets, size), size)
    # a queue's tokens before a source's documents in a task
    by_part = parts.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    bases = (parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
             .join(by_part.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), ["queue", "part"])
             .select("part", "source", "queue", (F.col("earlier") + F.col("inside")).alias("base")))
    placed = rows.join(broadcast_if(bases, broadcast_rows), ["part", "source"])
    placed = placed.select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return placed.mapInPandas(_pieces(p, numbers, with_ids), schema + (", ids array<int>" if with_ids else ""))


def _pieces(p: Plan, numbers: list[int], with_ids: bool):
    def stretch(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n, at = pdf["n"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
        queue = np.searchsorted(numbers, pdf["queue"].to_numpy(np.int64))
        ids = [np.frombuffer(x, f"<u{len(x) // k}").astype("<u4") for x, k in zip(pdf["ids"], n)]
        raw = [memoryview(x.tobytes()) for x in ids]
        for row, sequence, low, high, offset in places(p, queue, at, at + n):
            start = low - at[row]
            cuts = list(zip(row.tolist(), start.tolist(), (high - at[row]).tolist()))
            out = pd.DataFrame({"doc_id": pdf["doc_id"].take(row).astype("Int64").reset_index(drop=True), "start": start, "length": high - low,
                                "ids_crc32": [zlib.crc32(raw[r][4 * a:4 * b]) for r, a, b in cuts], "doc_tokens": n[row],
                                "sequence_id": sequence, "offset": offset, "source": pdf["source"].take(row).reset_index(drop=True)})
            if with_ids:
                out["ids"] = [ids[r][a:b].astype("i4") for r, a, b in cuts]
            yield out

    def run(batches):
        for pdf in batches:
            block = pdf["n"].cumsum() // BATCH_TOKENS
            for _, some in pdf.groupby(block, sort=False):
                yield from stretch(some.reset_index(drop=True))
    return run
