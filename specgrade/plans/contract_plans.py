"""Registered queries for the contracts around the stages: stage files, model
and embedding functions, direct fits, revisions, evaluation names (S3, S4, U2,
U4, B10, B11, F14, B19)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specgrade.functions import text as T
from specgrade.operators import features as FE
from specgrade.operators import inference as I
from specgrade.operators import stages as SG
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import CONSTRAINTS_TEXT, WS
from specgrade.plans.tables import constraints_text, table
from specgrade.session import ensure_checkpoint_dir
from specgrade.sources import corpus as SC


def _scratch(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/specgrade-{name}-{uuid.uuid4().hex}"


def _quoted(sql: str) -> str:
    """A template as an SQL string."""
    return "'" + sql.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("stage_files", """
WITH d AS (SELECT doc_id, coalesce(text, '') || ',"' || lang || '"' || chr(10) || 'next' AS text, doc_id / 8.0 AS similarity FROM documents)
SELECT fmt, doc_id, sha256(text) AS text_sha256, similarity FROM d, (VALUES ('csv'), ('parquet')) f(fmt)
""")
def stage_files(spark, sf):
    """S3+S4: a stage table with quotes, commas and line ends in its texts,
    written as CSV and as Parquet and read back with its schema."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(',"'), "lang", F.lit('"\nnext')).alias("text"),
                                             (F.col("doc_id") / 8.0).cast("double").alias("similarity"))
    out = None
    for fmt in ("csv", "parquet"):
        at = _scratch(spark, "stage") + "." + fmt
        SC.write_stage(d, at, fmt)
        back = SC.read_stage_csv(spark, at, "doc_id bigint, text string, similarity double") if fmt == "csv" else spark.read.parquet(at)
        rows = back.select(F.lit(fmt).alias("fmt"), "doc_id", F.sha2("text", 256).alias("text_sha256"), "similarity")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("infer_verdicts", f"""
SELECT instruction_number AS key, CASE WHEN contains(constraints, 'FAIL') THEN 'RuntimeError: stub failure' END AS error,
       CASE WHEN contains(constraints, 'FAIL') THEN 0 ELSE len(regexp_extract_all(constraints, '(?m)^[0-9]+\\.')) END AS output_tokens,
       CASE WHEN contains(constraints, 'FAIL') THEN NULL ELSE (len(regexp_extract_all(constraints, '(?m)^[0-9]+\\.')) + 1) // 2 END AS n_yes
FROM (SELECT instruction_number, constraints || CASE WHEN instruction_number % 19 = 0 THEN ' FAIL' ELSE '' END AS constraints FROM {CONSTRAINTS_TEXT})
""")
def infer_verdicts(spark, sf):
    """A model function called for every constraint list inside the tasks;
    a call that raises is an error in its row, never a failed job."""
    c = constraints_text(spark, sf).select("instruction_number", F.concat("constraints", F.when(F.col("instruction_number") % 19 == 0, " FAIL").otherwise("")).alias("p"))
    reqs = I.build_requests(c, "verdicts", "instruction_number", "{p}", {"p": "p"})
    at = _scratch(spark, "answers")
    I.infer(reqs, I.stub_verdict_model, max_attempts=2).write.parquet(at)
    return spark.read.parquet(at).select("key", "error", "output_tokens", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^[0-9]+\. Yes"), F.lit(0))).cast("bigint").alias("n_yes"))


def _text_shape():
    """A model for tests: characters, words and letters e of a text."""
    def encode(texts):
        return [[float(len(t)), float(len(t.split())), float(t.count("e"))] for t in texts]
    return encode


@query("embed_with_model", f"""
SELECT doc_id, CAST(length(t) AS DOUBLE) AS n_chars, CASE WHEN trim(t, {WS}) = '' THEN 0.0 ELSE CAST(len(string_split_regex(trim(t, {WS}), '\\s+')) AS DOUBLE) END AS n_words,
       CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS n_e
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def embed_with_model(spark, sf):
    """U4: vectors from a user's model, loaded once per task."""
    e = FE.embed_with(table(spark, sf, "documents").select("doc_id", "text"), "text", _text_shape, 3)
    return e.select("doc_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("n_chars", "n_words", "n_e"))])


_DIRECT = f"replace(replace({_quoted(SG.TEMPLATES['fit_direct'])}, '{{constraints}}', c.constraints), '{{content}}', m.text)"


@query("fit_direct_positional", f"""
WITH c AS (SELECT *, row_number() OVER (ORDER BY n) AS position FROM (SELECT instruction_number AS n, constraints FROM {CONSTRAINTS_TEXT})),
m AS (SELECT *, row_number() OVER (ORDER BY item_id DESC) AS position FROM benchmark)
SELECT position, n, sha256('default' || chr(1) || '' || chr(1) || {_DIRECT}) AS prompt_hash,
       CASE WHEN position % 4 = 0 THEN m.text ELSE 'fitted ' || position END AS fitted_content, CASE WHEN position % 4 = 0 THEN 'Timeout' END AS error
FROM c JOIN m USING (position)
""")
def fit_direct_positional(spark, sf):
    """B10 without a common key: constraints and merged texts (benchmark
    items, last first) paired by position, requests built, answers attached;
    a failed row keeps its merged text."""
    cons = constraints_text(spark, sf).select(F.col("instruction_number").alias("n"), "constraints")
    merged = table(spark, sf, "benchmark").select((-F.col("item_id")).alias("at"), F.col("text").alias("merged_blog"))
    orders = {"constraints_order": ["n"], "merged_order": ["at"]}
    reqs = SG.fit_direct_requests(SG.fit_direct_pairs(cons, merged, **orders), "position")
    answers = reqs.select("key", F.concat(F.lit("fitted "), F.col("key").cast("string")).alias("text"), F.when(F.col("key") % 4 == 0, "Timeout").alias("err"))
    out = SG.fit_direct_results(cons, merged, I.offline_responses(answers, "key", "text", "err"), "instruction_number", **orders)
    return out.join(reqs.select(F.col("key").alias("position"), "prompt_hash"), "position").select("position", "n", "prompt_hash", "fitted_content", "error")


@query("revise_stage", f"""
SELECT doc_id AS instruction_number, CASE WHEN blank OR doc_id % 13 = 0 THEN '' ELSE sha256(text || '!') END AS revised,
       CASE WHEN NOT blank AND doc_id % 13 = 0 THEN 'Timeout' END AS error,
       CAST(CASE WHEN blank OR doc_id % 13 = 0 THEN 0 ELSE len(string_split_regex(trim(text || '!', {WS}), '\\s+')) END AS BIGINT) AS tokens_used
FROM (SELECT doc_id, text, trim(coalesce(text, ''), {WS}) = '' AS blank
      FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN ' ' || chr(10) ELSE text END AS text FROM documents))
""")
def revise_stage(spark, sf):
    """B11 results: revised texts; rows with a blank base were never asked and
    stay empty without an error, failed ones have the error."""
    blank = F.when(F.col("doc_id") % 10 == 3, F.lit(" \n")).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"), blank.alias("base_content"), F.lit("1. x").alias("constraints"))
    asked = SG.revise_requests(d, "instruction_number", "base_content", "constraints").select(F.col("key").alias("instruction_number"))
    answers = d.join(asked, "instruction_number", "left_semi").select("instruction_number", F.concat("base_content", F.lit("!")).alias("text"),
                                                                      F.when(F.col("instruction_number") % 13 == 0, "Timeout").alias("err"))
    out = SG.revise_results(d, I.offline_responses(answers, "instruction_number", "text", "err"), "instruction_number", "base_content")
    revised = F.when(F.col("revised_content") == "", "").otherwise(F.sha2("revised_content", 256))
    return out.select("instruction_number", revised.alias("revised"), "error", "tokens_used")


@query("evaluation_names", f"""
SELECT 'legacy_eval:' || doc_id || ':1' AS request_id,
       sha256('default' || chr(1) || '' || chr(1) || replace(replace(replace({_quoted(SG.TEMPLATES['legacy_eval'])}, '{{story}}', coalesce(text, '')),
              '{{constraints}}', lang), '{{count}}', '7')) AS prompt_hash
FROM documents
""")
def evaluation_names(spark, sf):
    """F14+B17: a summarised table under the evaluation's names, asked by it."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("summarized_content"), F.col("lang").alias("selected_constraints"), F.lit(7).alias("subset_size"))
    return SG.legacy_eval_requests(SG.to_evaluation_names(d), "doc_id").select("request_id", "prompt_hash")


@query("notebook_names", """
SELECT source AS "Original Blog 1", lang AS "Original Blog 2", text AS "Merged Blog", n_chars / 8.0 AS "Similarity", text AS fitted_blog, lang AS fitted_summarized_blog
FROM documents
""")
def notebook_names(spark, sf):
    """Merged, fitted and summarised tables under the notebooks' names."""
    d = table(spark, sf, "documents").select(F.col("source").alias("original_blog_1"), F.col("lang").alias("original_blog_2"), F.col("text").alias("merged_blog"),
                                             (F.col("n_chars") / 8.0).cast("double").alias("similarity"), F.col("text").alias("fitted_content"), F.col("lang").alias("summarized_content"))
    return SG.to_legacy_names(d)
