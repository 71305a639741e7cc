"""Training-data pipeline over ``documents``: five stages, each an operator of
``specgrade.llm``, written as Parquet and reread as the next one's input.

Every stage keeps the columns of ``documents`` but the last, which gives the
packing.  A stage handles null and empty texts, repeated rows and empty tables
as its operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.llm.common import read
from specgrade.llm.decontaminate import decontaminate
from specgrade.llm.line_crf import classify, learn
from specgrade.llm.line_dedup import line_dedup
from specgrade.llm.ngram_jaccard import one_of_each
from specgrade.llm.packing import pack
from specgrade.session import ensure_checkpoint_dir

# Parameters of the near-duplicate stage: five words, a similarity of 0.8.
NEAR = {"k": 5, "num": 80, "den": 100}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go; columns named like its
    results are kept as they came."""
    model = learn(docs, read(spark, sf_dir, "labels"))
    aside = {c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns}
    kept = classify(docs.withColumnsRenamed(aside), model).filter("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({own: c for c, own in aside.items()}).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents hold go from every document."""
    kept = line_dedup(docs)
    n_chars = F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The field and the tokenizer are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
