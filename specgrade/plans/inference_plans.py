"""Registered queries for joins, request/response bookkeeping and stage stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions import text as T
from specgrade.operators import inference as I
from specgrade.operators import joins as J
from specgrade.operators import lists as OL
from specgrade.operators import stats as ST
from specgrade.operators import stages as SG
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import (ATTEMPT_LOG, CONSTRAINTS_TEXT, CONV_REQUESTS, CONV_RESPONSES,
                                      SATISFACTION_TEXT, parse_numbered_sql)
from specgrade.plans.tables import (attempt_log, constraints_text, conversation_requests, conversation_responses,
                                    satisfaction_text, table)

_ITEMS = parse_numbered_sql("constraints")
_BUCKETED = f"""(SELECT instruction_number, CAST(least(size, len(items)) AS INTEGER) AS subset_size
   FROM (SELECT instruction_number, {_ITEMS} AS items FROM {CONSTRAINTS_TEXT})
   CROSS JOIN (VALUES (7), (15), (23), (31), (39)) AS s(size))"""


def _bucketed(spark, sf):
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    return OL.expand_buckets(c).select("instruction_number", "subset_size")


def _base(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("instruction_number"), F.col("n_chars").alias("content_length"),
                    F.col("lang").alias("main_task"))


@query("join_fit", f"""
SELECT b.instruction_number, b.subset_size, d.n_chars AS content_length
FROM {_BUCKETED} b JOIN documents d ON d.doc_id = b.instruction_number
""")
def join_fit(spark, sf):
    """Bucketed constraints x base replicated to the same buckets, right
    side deduped per key (one output row per constraint row)."""
    base5 = _base(spark, sf).join(_bucketed(spark, sf), "instruction_number")  # base replicated 5x per key
    j = J.join_constraints_base(_bucketed(spark, sf), base5.drop("subset_size"), dedupe_right=True, order="content_length")
    return j.select("instruction_number", "subset_size", "content_length")


@query("join_fit_fanout", f"""
SELECT b.instruction_number, b.subset_size, d.n_chars AS content_length
FROM {_BUCKETED} b JOIN {_BUCKETED} b2 ON b2.instruction_number = b.instruction_number
JOIN documents d ON d.doc_id = b.instruction_number
""")
def join_fit_fanout(spark, sf):
    """J1 compat (Q2): without the right-side dedupe, 5 x 5 rows per key."""
    base5 = _base(spark, sf).join(_bucketed(spark, sf), "instruction_number").drop("subset_size")
    j = J.join_constraints_base(_bucketed(spark, sf), base5, dedupe_right=False)
    return j.select("instruction_number", "subset_size", "content_length")


@query("join_three", f"""
SELECT c.instruction_number, d.lang AS main_task, length(c.constraints) AS constraints_length,
       length(s.satisfaction_results) AS results_length
FROM {CONSTRAINTS_TEXT} c JOIN documents d ON d.doc_id = c.instruction_number
JOIN {SATISFACTION_TEXT} s ON s.instruction_number = c.instruction_number
""")
def join_three(spark, sf):
    """Constraints x base x evaluation on instruction_number."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    b = _base(spark, sf).select("instruction_number", "main_task")
    e = satisfaction_text(spark, sf).select("instruction_number", "satisfaction_results")
    j = J.join_three(c, b, e)
    return j.select("instruction_number", "main_task",
                    T.char_length("constraints").alias("constraints_length"),
                    T.char_length("satisfaction_results").alias("results_length"))


@query("replicate_left", """
SELECT d.doc_id, d.lang, g.task_len FROM documents d
LEFT JOIN (SELECT lang, CAST(length('Write about ' || lang) AS BIGINT) AS task_len FROM documents GROUP BY lang) g
ON g.lang = d.lang
""")
def replicate_left(spark, sf):
    """One generated value per distinct task, replicated to all rows."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    gen = J.dedupe_first(d, "lang", "doc_id").select(
        "lang", T.char_length(F.concat(F.lit("Write about "), F.col("lang"))).alias("task_len"))
    return J.replicate_left(d, gen, "lang", ["task_len"])


@query("dedupe_first", """
SELECT source, doc_id, lang FROM (
  SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def dedupe_first(spark, sf):
    """First document (by doc_id) per source."""
    d = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return J.dedupe_first(d, "source", "doc_id")


@query("dup_count", "SELECT CAST(count(*) - count(DISTINCT lang) AS BIGINT) AS n_duplicates FROM documents")
def dup_count(spark, sf):
    """Rows beyond the first per key."""
    return J.duplicate_count(table(spark, sf, "documents"), "lang")


@query("join_pruned", f"""
SELECT c.instruction_number, length(d.text) AS content_length FROM {CONSTRAINTS_TEXT} c
JOIN documents d ON d.doc_id = c.instruction_number
""")
def join_pruned(spark, sf):
    """Constraints joined to only (key, content) of the documents."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "instruction_number")
    return J.join_pruned(c, d, "instruction_number", ["text"]).select(
        "instruction_number", T.char_length("text").alias("content_length"))


@query("zip_join", """
SELECT a.rn AS position, a.doc_id, b.item_id FROM
  (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) a
  JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) b ON a.rn = b.rn
""")
def zip_join(spark, sf):
    """Documents paired with benchmark items by position."""
    d = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "benchmark").select("item_id")
    return J.zip_join(d, b, ["doc_id"], ["item_id"], warn=False).select("position", "doc_id", "item_id")


_TPL = SG.TEMPLATES["constraints"].replace("'", "''").replace("\n", "' || chr(10) || '")


@query("build_requests", f"""
SELECT 'constraints:' || CAST(doc_id AS VARCHAR) || ':1' AS request_id, doc_id AS key,
       sha256('default' || chr(1) || '' || chr(1) || replace('{_TPL}', '{{content}}', coalesce(text, ''))) AS prompt_hash,
       CAST(length(replace('{_TPL}', '{{content}}', coalesce(text, ''))) AS BIGINT) AS prompt_length
FROM documents
""")
def build_requests(spark, sf):
    """B1: one constraint-generation request per document."""
    d = table(spark, sf, "documents")
    r = SG.constraints_requests(d, "doc_id", "text")
    return r.select("request_id", "key", "prompt_hash",
                    T.char_length(F.col("messages")[0]["content"]).alias("prompt_length"))


@query("dedupe_requests", f"""
SELECT min(doc_id) AS key, sha256('default' || chr(1) || '' || chr(1) ||
       replace('{SG.TEMPLATES["base"].replace(chr(10), "' || chr(10) || '")}', '{{main_task}}', lang)) AS prompt_hash
FROM documents GROUP BY lang
""")
def dedupe_requests(spark, sf):
    """B2: base requests whose task is the language: one call per distinct prompt."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    r = I.build_requests(d, "base", "doc_id", SG.TEMPLATES["base"], {"main_task": "lang"})
    return I.dedupe_requests(r).select("key", "prompt_hash")


@query("retry_plan", f"""
SELECT r.key, CAST(coalesce(l.attempt + 1, 1) AS INTEGER) AS attempt FROM {CONV_REQUESTS} r
LEFT JOIN (SELECT key, max(attempt) AS attempt, arg_max(coalesce(error, ''), attempt) AS error FROM {ATTEMPT_LOG} GROUP BY key) l
  ON l.key = r.key
WHERE l.key IS NULL OR (l.error <> '' AND l.attempt < 3)
""")
def retry_plan(spark, sf):
    """Requests to re-issue after failed attempts (max 3)."""
    reqs = I.build_requests(conversation_requests(spark, sf), "chat", "key", "{p}", {"p": "prompt"})
    return I.retry_plan(reqs, attempt_log(spark, sf), 3).select("key", "attempt")


@query("attach_responses", f"""
SELECT r.conv_id, r.turn, coalesce(s.text, '') AS answer, CASE WHEN s.key IS NULL THEN 'no response' END AS error,
       CAST(coalesce(s.input_tokens, 0) + coalesce(s.output_tokens, 0) AS BIGINT) AS tokens_used
FROM {CONV_REQUESTS} r LEFT JOIN {CONV_RESPONSES} s ON s.key = r.key
""")
def attach_responses(spark, sf):
    """Every user turn with its answer; no answer -> '' and an error."""
    r = conversation_requests(spark, sf)
    a = I.attach_responses(r, conversation_responses(spark, sf), "key", "answer", F.lit(""))
    return a.select("conv_id", "turn", "answer", "error", "tokens_used")


def _merged(spark, sf):
    r = conversation_requests(spark, sf)
    a = I.attach_responses(r, conversation_responses(spark, sf), "key", "merged_blog", F.lit(""))
    return a.withColumn("merged_length", T.char_length("merged_blog"))


@query("merge_summary", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE merged_length > 0) AS n_success,
       avg(merged_length) AS mean_merged_length, CAST(sum(tokens_used) AS BIGINT) AS total_tokens
FROM (SELECT CAST(length(coalesce(s.text, '')) AS BIGINT) AS merged_length,
             coalesce(s.input_tokens, 0) + coalesce(s.output_tokens, 0) AS tokens_used
      FROM {CONV_REQUESTS} r LEFT JOIN {CONV_RESPONSES} s ON s.key = r.key)
""")
def merge_summary(spark, sf):
    """Successes, mean merged length and total tokens of a merge stage."""
    return ST.merge_summary(_merged(spark, sf))


_RATIO = f"""(SELECT r.key, CASE WHEN s.key IS NULL THEN 1.0
                    WHEN length(coalesce(r.prompt, '')) > 0 THEN length(s.text) / length(coalesce(r.prompt, ''))
                    ELSE 0.0 END AS compression_ratio
             FROM {CONV_REQUESTS} r LEFT JOIN {CONV_RESPONSES} s ON s.key = r.key)"""


def _summarized(spark, sf):
    r = conversation_requests(spark, sf)
    return SG.summarize_results(r, conversation_responses(spark, sf), "key", "prompt")


@query("compression_ratio", f"SELECT key, compression_ratio FROM {_RATIO}")
def compression_ratio(spark, sf):
    """summary/original length; failure keeps the original (ratio 1.0)."""
    return _summarized(spark, sf).select("key", "compression_ratio")


@query("compression_summary", f"""
SELECT count(*) AS n_rows, avg(compression_ratio) AS mean_ratio, CAST(0.25 AS DOUBLE) AS target_ratio,
       avg(compression_ratio) - 0.25 AS ratio_gap FROM {_RATIO}
""", round_cols=('mean_ratio', 'ratio_gap'))
def compression_summary(spark, sf):
    """A10: mean compression vs. the 25 % target."""
    return ST.compression_summary(_summarized(spark, sf), 0.25)


_CONS_SPLIT = f"list_filter(string_split({_ITEMS.replace('constraints', 'c.constraints')}, chr(10)), lambda x: true)"


@query("evaluate_stage", f"""
SELECT c.instruction_number,
       CASE WHEN c.instruction_number % 10 = 0 THEN 0
            ELSE CAST(len(list_filter(regexp_extract_all(s.satisfaction_results, '(?m)^\\s*[0-9]+\\.\\s*(Yes|No)\\b', 1), lambda x: x = 'Yes')) AS BIGINT) END AS num_satisfied,
       CAST(len(regexp_extract_all(c.constraints, '(?m)^[0-9]+\\.')) AS BIGINT) AS total_constraints,
       CASE WHEN c.instruction_number % 10 = 0 THEN NULL
            WHEN len(regexp_extract_all(c.constraints, '(?m)^[0-9]+\\.')) > 0
            THEN len(list_filter(regexp_extract_all(s.satisfaction_results, '(?m)^\\s*[0-9]+\\.\\s*(Yes|No)\\b', 1), lambda x: x = 'Yes'))
                 / len(regexp_extract_all(c.constraints, '(?m)^[0-9]+\\.'))
            ELSE 0.0 END AS satisfaction_rate,
       CASE WHEN c.instruction_number % 10 = 0 THEN '' ELSE s.satisfaction_results END AS satisfaction_results,
       CASE WHEN c.instruction_number % 10 = 0 THEN 'Timeout' END AS error
FROM {CONSTRAINTS_TEXT} c JOIN {SATISFACTION_TEXT} s ON s.instruction_number = c.instruction_number
""")
def evaluate_stage(spark, sf):
    """B13 end-to-end on derived responses: verdict text per document, every
    tenth request failed (rate null, error kept, row not lost)."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    s = satisfaction_text(spark, sf)
    resp = s.select(F.concat_ws(":", F.lit("evaluate"), F.col("instruction_number").cast("string"), F.lit("1"))
                    .alias("request_id"), F.col("instruction_number").alias("key"), F.lit(1).alias("attempt"),
                    F.when(F.col("instruction_number") % 10 != 0, F.col("satisfaction_results")).alias("text"),
                    F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
                    F.when(F.col("instruction_number") % 10 == 0, F.lit("Timeout")).alias("error"))
    ev = SG.evaluate_results(c, resp, "instruction_number")
    return ev.select("instruction_number", "num_satisfied", "total_constraints", "satisfaction_rate",
                     "satisfaction_results", "error")
