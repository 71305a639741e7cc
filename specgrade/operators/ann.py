"""Approximate nearest neighbours (P9) by signed random projections.

A vector's code in a table is the signs of its projections on that table's
hyperplanes; near vectors share codes.  The index holds every vector once per
table.  A query probes in each table its own code and the codes with its
``flips`` least certain signs turned, in every combination, meets the vectors
of those buckets in an equi-join, and its candidates are scored by the exact
inner product, so an answer's score never is an estimate; what can be missed
is a neighbour that shares no probed bucket.

Codes have log2(rows / bucket_rows) bits, so a bucket holds about
``bucket_rows`` vectors at any table size and the work grows in proportion to
the rows.  A bucket that many equal or near vectors share is cut into blocks,
and the queries that probe one bucket into slices: a task scores one block
against one slice and sends its k best per query, and no group grows with a
hot bucket.  The exact search is ``pairing.knn``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.operators.pairing import BLOCK_ROWS, _merge_topk, _query_stats, _topk_scorer, prepare_vectors

ROWS = "bucket long, _id long, _v array<double>"


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 0) -> np.ndarray:
    """tables x bits x dim of +1 and -1, from a digest of the place."""
    def sign(*at) -> int:
        return 1 - 2 * (hashlib.md5(":".join(map(str, (seed, *at))).encode()).digest()[0] & 1)
    return np.array([[[sign(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)], dtype=np.float64).reshape(tables, bits, dim)


def code_bits(rows: int, bucket_rows: int) -> int:
    """The bits that leave about ``bucket_rows`` of ``rows`` in a bucket."""
    return max(0, (max(1, -(-rows // bucket_rows)) - 1).bit_length())


@dataclass(frozen=True)
class LshIndex:
    """Rows (bucket, _id, _v), one per vector and table; bucket = table << bits | code."""

    rows: DataFrame
    n: int
    dim: int
    tables: int
    bits: int
    seed: int

    def planes(self) -> np.ndarray:
        return hyperplanes(self.dim, self.tables, self.bits, self.seed)

    def save(self, path: str) -> None:
        """The rows and, beside them, what it takes to read them again."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        about = json.dumps({k: getattr(self, k) for k in ("n", "dim", "tables", "bits", "seed")})
        self.rows.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LshIndex:
        return LshIndex(spark.read.parquet(f"{path}/rows"), **json.loads(spark.read.text(f"{path}/about").first()[0]))


def _codes(vectors: DataFrame, planes: np.ndarray, flips: int) -> DataFrame:
    """``vectors`` once per table and probed code."""
    tables, bits, dim = planes.shape
    flat = planes.reshape(tables * bits, dim)
    turned = [c for r in range(min(flips, bits) + 1) for c in combinations(range(min(flips, bits)), r)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
            at = (m @ flat.T).reshape(len(m), tables, bits)
            code = ((at > 0) * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)
            unsure = np.argsort(np.abs(at), axis=2, kind="stable")
            for t in range(tables):
                for c in turned:
                    mask = np.zeros(len(m), np.int64)
                    for r in c:
                        mask |= 1 << unsure[:, t, r]
                    yield pdf.assign(bucket=(t << bits) | (code[:, t] ^ mask))[["bucket", "_id", "_v"]]
    return vectors.select("_id", "_v").mapInPandas(run, ROWS)


def build_lsh(corpus: DataFrame, tables: int = 8, bucket_rows: int = 1024, seed: int = 0, id_col: str = "vec_id",
              vec: str = "embedding", normalize: bool = True) -> LshIndex:
    """Index every row of ``corpus`` that has a vector (see ``prepare_vectors``)."""
    held = prepare_vectors(corpus, id_col, vec, normalize)
    st = _query_stats(held)
    bits = code_bits(st["n"], bucket_rows)
    rows = _codes(held, hyperplanes(st["d"] or 0, tables, bits, seed), 0)
    return LshIndex(rows, st["n"], st["d"] or 0, tables, bits, seed)


def search_lsh(index: LshIndex, queries: DataFrame, k: int, flips: int = 2, exclude_self: bool = False, id_col: str = "vec_id",
               vec: str = "embedding", normalize: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """The k best candidates of each query: (query_id, id, score, rank), fewer
    where its buckets hold fewer."""
    if not index.n:
        return queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    rows = index.rows.checkpoint()
    asks = _codes(prepare_vectors(queries, id_col, vec, normalize), index.planes(), flips).checkpoint()
    # blocks of a bucket by its vectors, slices by the queries that probe it
    held = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = asks.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices"))
    shape = held.join(asked, "bucket")

    def dealt(df: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        """Each row in its own part of its bucket, once per part of the other side."""
        part = F.pmod(F.xxhash64("_id", F.lit(salt)), F.col(own)).cast("int")
        return (df.join(shape, "bucket").withColumn("_own", part)
                .select("bucket", "_id", "_v", F.col("_own").alias(own[:-1]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])))

    def score(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ask) and len(have):
            m = np.stack(ask["_v"].to_numpy()).astype(np.float64)
            found = list(_topk_scorer(ask["_id"].to_numpy(np.int64), m, k, exclude_self)([have[["_id", "_v"]]]))
        return found[0] if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["bucket", "block", "slice"]
    met = (dealt(asks, "slices", "blocks", 1).groupBy(*keys)
           .cogroup(dealt(rows, "blocks", "slices", 0).groupBy(*keys))
           .applyInPandas(score, "query_id long, id long, score double"))
    # a neighbour that shares several buckets with a query is found in each
    return _merge_topk(met.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int, tables: int = 8, bucket_rows: int = 1024, flips: int = 2, seed: int = 0,
            exclude_self: bool = False, id_col: str = "vec_id", vec: str = "embedding", normalize: bool = True) -> DataFrame:
    """P9, approximate: build an index over ``corpus`` and search it."""
    index = build_lsh(corpus, tables, bucket_rows, seed, id_col, vec, normalize)
    return search_lsh(index, queries, k, flips, exclude_self, id_col, vec, normalize)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_truth, n_found, recall): how many of the true neighbours were found."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_truth"), F.count("_hit").alias("n_found"),
                    (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
