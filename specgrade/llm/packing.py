"""Best-fit packing after a Martello-Toth dominance reduction.

Documents are tokenized, closed with an end id and cut into pieces of at most
``size`` tokens; the first piece of a long document takes the remainder, all
others are full.  The packing instance is the histogram of piece lengths (at
most ``size`` rows); :mod:`packing_plan` reduces it by dominance and best-fits
the rest into a list of patterns.  Each piece's place follows from its rank
among the pieces of its length.  Ranks come from (length, bucket) groups of
bounded size plus running bucket totals, so a length that a third of all
pieces share is still ranked by many tasks.

Defined results: null text counts as empty and packs as the end id alone.
Repeated rows are packed each on its own.  An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgrade.llm.common import cut, whole_text
from specgrade.llm.encoding import VOCABULARY, byte_bpe
from specgrade.llm.packing_plan import Pattern, plan

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = PIECES + ", ids array<int>"


def _cut(ids: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a document."""
    first = len(ids) % size or size
    yield 0, min(first, len(ids))
    for start in range(first, len(ids), size):
        yield start, start + size


def pieces(docs: DataFrame, size: int, end_id: int, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""
    def encode(batches):
        encode_text = byte_bpe(vocabulary)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(np.asarray(encode_text(text), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                for k, (a, b) in enumerate(_cut(ids, size)):
                    row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    out.append(row + (ids[a:b].astype("i4"),) if with_ids else row)
            schema = PIECES_IDS if with_ids else PIECES
            got = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield got.astype({"doc_id": "Int64"})
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(encode, PIECES_IDS if with_ids else PIECES)


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length the runs of ranks that one pattern takes: from
    ``first`` on, ``copies`` to a sequence, numbered from ``sequence``, at
    ``offset`` and after it."""
    rows, seen, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length in sorted(set(p.lengths), reverse=True):
            copies = p.lengths.count(length)
            first = seen.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            seen[length] = first + copies * p.times
            offset += copies * length
        sequence += p.times
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"]).astype("int64")


def _placer(table: pd.DataFrame):
    """Places pieces by (length, rank): the slots are sorted by both."""
    table = table.sort_values(["length", "first"])
    span = int(table["first"].max() + 1) if len(table) else 1
    keys = table["length"].to_numpy() * span + table["first"].to_numpy()
    columns = {c: table[c].to_numpy() for c in ("length", "first", "copies", "sequence", "offset")}

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            nth = rank - columns["first"][at]
            pdf["sequence_id"] = columns["sequence"][at] + nth // columns["copies"][at]
            pdf["offset"] = columns["offset"][at] + nth % columns["copies"][at] * length
            yield pdf.drop(columns=["rank"])
    return place


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY,
         rows_per_group: int = 20_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset; ``with_ids`` adds the piece's ids."""
    cut_up = cut(pieces(docs, size, end_id, vocabulary, with_ids))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    buckets = max(1, -(-sum(counts.values()) // rows_per_group))
    bucketed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    totals = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (bucketed.withColumn("nth", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
              .withColumn("rank", F.col("base") + F.col("nth")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = (PIECES_IDS if with_ids else PIECES) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(_placer(slots(plan(counts, size))), schema)
