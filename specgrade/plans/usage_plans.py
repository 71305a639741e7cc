"""Registered queries for usage logs, resume planning and the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specgrade.operators import stats as ST
from specgrade.plans.registry import query
from specgrade.plans.tables import table
from specgrade.session import ensure_checkpoint_dir
from specgrade.sources import corpus as SC
from specgrade.sources import usage_log as UL
from specgrade.sources.feature_table import FeatureTable
from specgrade.streaming.usage import read_usage_totals, usage_totals_stream

_ROLLUP = """
SELECT event_type AS provider, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS calls
FROM events GROUP BY ROLLUP (event_type)
"""


@query("usage_parse", """
SELECT date_trunc('second', ts) AS ts, event_type AS provider,
       'model-' || CAST(user_id % 3 AS VARCHAR) AS model, CAST(floor(value) AS BIGINT) AS tokens,
       CASE WHEN event_id % 2 = 0 THEN props END AS metadata
FROM events
""")
def usage_parse(spark, sf):
    """Usage-log lines rendered from events, parsed back (4 or 5 fields)."""
    p = UL.parse_usage(UL.usage_lines(table(spark, sf, "events")))
    return p.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("usage_rollup", _ROLLUP)
def usage_rollup(spark, sf):
    """Tokens and calls per provider plus the grand total (rollup)."""
    return ST.usage_rollup(UL.parse_usage(UL.usage_lines(table(spark, sf, "events"))))


@query("usage_cost", """
SELECT provider, tokens, calls, CAST(tokens AS DOUBLE) * CAST(0.0015 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS cost FROM (
""" + _ROLLUP + ")")
def usage_cost(spark, sf):
    """Token cost at 0.0015 per 1000 tokens."""
    return ST.usage_cost(ST.usage_rollup(UL.parse_usage(UL.usage_lines(table(spark, sf, "events")))))


@query("legacy_usage", """
SELECT CAST(ts AS DATE) AS day, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1
""")
def legacy_usage(spark, sf):
    """Legacy 'MM-dd-yyyy HH:mm:ss : tokens' lines parsed, tokens per day."""
    p = UL.parse_legacy_line("value")
    rows = UL.legacy_lines(table(spark, sf, "events")).select(p.alias("u")).filter(F.col("u").isNotNull())
    return rows.groupBy(F.to_date("u.ts").alias("day")).agg(F.sum("u.tokens").cast("bigint").alias("tokens"))


@query("resume_todo", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def resume_todo(spark, sf):
    """Documents still to process when ``labels`` holds the finished keys."""
    return SC.resume_todo(table(spark, sf, "documents").select("doc_id"),
                          table(spark, sf, "labels"), "doc_id")


@query("usage_stream_rollup", """
SELECT event_type AS provider, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS calls
FROM events GROUP BY event_type
""")
def usage_stream_rollup(spark, sf):
    """The usage log (rendered from events into the checkpoint folder)
    consumed by a Structured Streaming complete-mode aggregate with
    availableNow; the streamed totals equal the batch rollup."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/specgrade-usage-{uuid.uuid4().hex}"
    UL.usage_lines(table(spark, sf, "events")).write.mode("overwrite").text(base + "/in")
    q = usage_totals_stream(spark, base + "/in", base + "/out", base + "/ckpt")
    q.awaitTermination()
    return read_usage_totals(spark, base + "/out")


def _scratch(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/specgrade-{name}-{uuid.uuid4().hex}"


def _jsonl_corpus(spark, sf):
    from specgrade.plans.tables import write_corpus_jsonl
    base = _scratch(spark, "jsonl")
    write_corpus_jsonl(spark, sf, base + "/in/dump")
    return base


def _parse_corpus_sql(extra_where: str) -> str:
    from specgrade.plans.sqlparts import BLOG_REASON, CORPUS, S, URL_PARTS
    return f"""
SELECT CAST(doc_id AS VARCHAR) AS id, url, source, replace({S}, chr(10), ' ') AS text,
       length(replace({S}, chr(10), ' ')) AS text_length
FROM (SELECT c.*, {URL_PARTS} FROM {CORPUS} c)
WHERE coalesce(url, '') <> '' AND coalesce(text, '') <> ''
  AND length(replace({S}, chr(10), ' ')) BETWEEN 1000 AND 2000
  AND ({BLOG_REASON}) IS NOT NULL {extra_where}
"""


@query("ingest_jsonl", _parse_corpus_sql("AND doc_id % 50 <> 0"))
def ingest_jsonl(spark, sf):
    """S1+F10: the corpus as JSON-lines dumps (every 50th line malformed),
    read with an explicit schema (bad lines quarantined), then filtered."""
    from specgrade.operators.corpus import parse_corpus
    base = _jsonl_corpus(spark, sf)
    good, _bad = SC.read_corpus_jsonl(spark, base + "/in", glob="*.txt")
    return parse_corpus(good, 1000, 2000).drop("created", "added")


@query("ingest_quarantine", "SELECT count(*) AS bad_lines FROM documents WHERE doc_id % 50 = 0")
def ingest_quarantine(spark, sf):
    """Malformed dump lines land in the quarantine frame, never fail the job."""
    base = _jsonl_corpus(spark, sf)
    _good, bad = SC.read_corpus_jsonl(spark, base + "/in", glob="*.txt")
    return bad.agg(F.count(F.lit(1)).alias("bad_lines"))


@query("classify_stream", _parse_corpus_sql("AND doc_id % 50 <> 0"))
def classify_stream(spark, sf):
    """the same dumps consumed by a Structured Streaming query
    (availableNow, file sink with checkpoint); output equals the batch run."""
    from specgrade.streaming.usage import classify_stream as run
    base = _jsonl_corpus(spark, sf)
    q = run(spark, base + "/in/dump", base + "/out", base + "/ckpt", 1000, 2000)
    q.awaitTermination()
    return spark.read.parquet(base + "/out").drop("created", "added")


@query("classify_stream_quarantine", f"""
SELECT 'kept' AS kind, id, text_length, CAST(NULL AS BIGINT) AS line_length FROM ({_parse_corpus_sql("AND doc_id % 50 <> 0")})
UNION ALL SELECT 'bad', NULL, NULL, 20 FROM documents WHERE doc_id % 50 = 0
""")
def classify_stream_quarantine(spark, sf):
    """F18+S1: the same dumps as one stream with two results: kept rows, and
    the malformed lines with their file."""
    from specgrade.streaming import usage as U
    base = _jsonl_corpus(spark, sf)
    U.classify_stream_quarantine(spark, base + "/in/dump", base + "/out", base + "/ckpt", 1000, 2000, max_files_per_trigger=1).awaitTermination()
    kept = U.read_classified(spark, base + "/out").select(F.lit("kept").alias("kind"), "id", "text_length", F.lit(None).cast("bigint").alias("line_length"))
    bad = U.read_quarantine(spark, base + "/out").filter("file IS NOT NULL")
    return kept.unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("text_length"),
                                       F.length("line").cast("bigint").alias("line_length")))


@query("feature_states", """
WITH before AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' (draft)' ELSE '' END AS text FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT d.doc_id, d.text, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN b.text = d.text THEN 'unchanged' ELSE 'changed' END AS state
      FROM d LEFT JOIN before b USING (doc_id))
SELECT doc_id, sha256(text) AS text_hash, state, state <> 'unchanged' AND text NOT IN (SELECT text FROM before) AS computed,
       CAST(length(text) AS BIGINT) AS n_chars FROM s
""")
def feature_states(spark, sf):
    """A feature table filled from an earlier state of the documents (every
    7th not there yet, every 11th a draft) and updated: new, changed and
    unchanged rows, and whose text had to be computed."""
    from specgrade.functions.text import char_length
    docs = table(spark, sf, "documents").select("doc_id", "text")
    draft = F.when(F.col("doc_id") % 11 == 0, F.lit(" (draft)")).otherwise("")
    before = docs.filter(F.col("doc_id") % 7 != 0).withColumn("text", F.concat(F.coalesce("text", F.lit("")), draft))
    features = FeatureTable(spark, _scratch(spark, "features"), "lengths", {"unit": "code points"})
    lengths = lambda texts: texts.select("text_hash", char_length("text").alias("n_chars"))
    features.update(before, "doc_id", lengths)
    return features.update(docs, "doc_id", lengths)


@query("ingest_gz", _parse_corpus_sql("AND doc_id % 50 <> 0"))
def ingest_gz(spark, sf):
    """Gzip-compressed dumps read directly (no unpack step), then F10."""
    from specgrade.operators.corpus import parse_corpus
    from specgrade.plans.tables import write_corpus_jsonl
    base = _scratch(spark, "gz")
    write_corpus_jsonl(spark, sf, base + "/in/dump", compression="gzip")
    good, _bad = SC.read_compressed_corpus(spark, base + "/in", "gz", glob="*.gz")
    return parse_corpus(good, 1000, 2000).drop("created", "added")
