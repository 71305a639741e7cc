"""Registered data-quality queries: first violated rule per row, per stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions import lists as L
from specgrade.functions import scoring as S
from specgrade.functions import text as T
from specgrade.operators import quality as Q
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import CONSTRAINTS_TEXT, CORPUS, SATISFACTION_TEXT, TASK_RESPONSES, WS
from specgrade.plans.tables import constraints_text, corpus_with_urls, satisfaction_text, table, task_responses

def _stamp():
    return {"model_used": F.lit("stub-model"), "timestamp": F.current_timestamp()}


def _raw(spark, sf):
    c = corpus_with_urls(spark, sf)
    return c.select(F.col("doc_id").cast("string").alias("id"), "url", "source",
                    T.normalize_text("text").alias("text")).withColumn("text_length", T.char_length("text"))


@query("dq_raw", f"""
SELECT id, rule_id FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN NOT coalesce(length(replace(trim(text, {WS}), chr(10), ' ')) > 0, false) THEN 'V1'
              WHEN coalesce(trim(text, {WS}), '') = '' THEN 'V2'
              WHEN NOT coalesce(regexp_matches(url, '^https?://'), false) THEN 'V3' END AS rule_id
  FROM {CORPUS} c)
WHERE rule_id IS NOT NULL
""")
def dq_raw(spark, sf):
    """V1-V3 on the url-tagged corpus in raw_blogs shape."""
    return Q.validate(_raw(spark, sf), "raw_blogs", "id").select("id", "rule_id")


def _constraints_stage(spark, sf):
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    t = L.with_task_split(task_responses(spark, sf), "response", "s")
    return (c.join(t.select("instruction_number", "s.main_task"), "instruction_number")
             .withColumn("instruction", F.lit("Extract constraints")).withColumns(_stamp()))


_TASK_SQL = (f"coalesce(trim(replace(list_filter(list_transform(string_split(trim(response, {WS}), chr(10)), "
             f"lambda x: trim(x, {WS})), lambda x: starts_with(x, 'Main Task:'))[-1], 'Main Task:', ''), {WS}), '')")


@query("dq_constraints", f"""
SELECT instruction_number, rule_id FROM (
  SELECT c.instruction_number,
         CASE WHEN NOT coalesce(c.instruction_number > 0, false) THEN 'V7'
              WHEN len(regexp_extract_all(constraints, '(?m)^[0-9]+\\.')) <> 39 THEN 'V8'
              WHEN {_TASK_SQL} = '' THEN 'V9' END AS rule_id
  FROM {CONSTRAINTS_TEXT} c JOIN {TASK_RESPONSES} t ON c.instruction_number = t.instruction_number)
WHERE rule_id IS NOT NULL
""")
def dq_constraints(spark, sf):
    """V7-V9: positive key, exactly 39 numbered lines, non-blank task."""
    return Q.validate(_constraints_stage(spark, sf), "constraints", "instruction_number").select(
        "instruction_number", "rule_id")


def _evaluation_stage(spark, sf):
    st = satisfaction_text(spark, sf)
    num = S.count_yes("satisfaction_results")
    return (st.withColumn("num_satisfied", num)
              .withColumn("total_constraints", F.col("subset_size"))
              .withColumn("satisfaction_rate", S.satisfaction_rate("num_satisfied", "total_constraints"))
              .withColumn("fitted_content", F.lit("x")).withColumn("constraints", F.lit("x"))
              .withColumn("tokens_used", F.lit(1).cast("bigint")).withColumns(_stamp()))


_NUMY = ("len(list_filter(regexp_extract_all(satisfaction_results, '(?m)^\\s*[0-9]+\\.\\s*(Yes|No)\\b', 1), "
         "lambda x: x = 'Yes'))")


@query("dq_evaluation", f"""
SELECT instruction_number, rule_id FROM (
  SELECT instruction_number,
         CASE WHEN NOT coalesce(instruction_number > 0, false) THEN 'V7'
              WHEN subset_size <> 39 THEN 'V14'
              WHEN NOT ({_NUMY} BETWEEN 0 AND 39) THEN 'V15'
              WHEN NOT coalesce(abs((CASE WHEN subset_size > 0 THEN {_NUMY} / subset_size ELSE 0.0 END)
                                    - CASE WHEN subset_size <> 0 THEN {_NUMY} / subset_size END) <= 0.01, false) THEN 'V16'
              WHEN len(regexp_extract_all(satisfaction_results, '(?m)^[0-9]+\\.\\s+(Yes|No)\\s+-')) <> 39 THEN 'V17'
         END AS rule_id
  FROM {SATISFACTION_TEXT})
WHERE rule_id IS NOT NULL
""")
def dq_evaluation(spark, sf):
    """V7, V14-V17 on evaluation rows."""
    return Q.validate(_evaluation_stage(spark, sf), "evaluation", "instruction_number").select(
        "instruction_number", "rule_id")


@query("dq_evaluation_by_bucket", f"""
SELECT instruction_number, rule_id FROM (
  SELECT instruction_number,
         CASE WHEN NOT coalesce(instruction_number > 0, false) THEN 'V7'
              WHEN NOT ({_NUMY} BETWEEN 0 AND subset_size) THEN 'V15'
              WHEN NOT coalesce(abs((CASE WHEN subset_size > 0 THEN {_NUMY} / subset_size ELSE 0.0 END)
                                    - CASE WHEN subset_size <> 0 THEN {_NUMY} / subset_size END) <= 0.01, false) THEN 'V16'
              WHEN len(regexp_extract_all(satisfaction_results, '(?m)^[0-9]+\\.\\s+(Yes|No)\\s+-')) <> subset_size THEN 'V17'
         END AS rule_id
  FROM {SATISFACTION_TEXT})
WHERE rule_id IS NOT NULL
""")
def dq_evaluation_by_bucket(spark, sf):
    """Q13: the same rules with n=None, i.e. compared with each row's subset_size."""
    return Q.validate(_evaluation_stage(spark, sf), "evaluation", "instruction_number", n=None).select(
        "instruction_number", "rule_id")


def _base_stage(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("instruction_number"), F.col("lang").alias("main_task"),
                    F.col("text").alias("base_content"), F.col("n_chars").alias("content_length"),
                    T.word_count("text").alias("tokens_used")).withColumns(_stamp())


@query("dq_base", f"""
SELECT instruction_number, rule_id FROM (
  SELECT doc_id AS instruction_number,
         CASE WHEN NOT coalesce(doc_id > 0, false) THEN 'V7'
              WHEN NOT coalesce(n_chars > 0 AND abs(length(coalesce(text, '')) - n_chars) <= 10, false) THEN 'V10'
              WHEN NOT coalesce((CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE len(string_split_regex(trim(text, {WS}), '\\s+')) END) > 0, false) THEN 'V11'
         END AS rule_id
  FROM documents)
WHERE rule_id IS NOT NULL
""")
def dq_base(spark, sf):
    """V7, V10, V11 on documents seen as base_generated rows."""
    return Q.validate(_base_stage(spark, sf), "base_generated", "instruction_number").select(
        "instruction_number", "rule_id")


@query("dq_summary", f"""
SELECT rule_id, count(*) AS n_violations FROM (
  SELECT CASE WHEN NOT coalesce(instruction_number > 0, false) THEN 'V7'
              WHEN subset_size <> 39 THEN 'V14'
              WHEN NOT ({_NUMY} BETWEEN 0 AND 39) THEN 'V15'
              WHEN NOT coalesce(abs((CASE WHEN subset_size > 0 THEN {_NUMY} / subset_size ELSE 0.0 END)
                                    - CASE WHEN subset_size <> 0 THEN {_NUMY} / subset_size END) <= 0.01, false) THEN 'V16'
              WHEN len(regexp_extract_all(satisfaction_results, '(?m)^[0-9]+\\.\\s+(Yes|No)\\s+-')) <> 39 THEN 'V17'
         END AS rule_id
  FROM {SATISFACTION_TEXT})
WHERE rule_id IS NOT NULL GROUP BY rule_id
""")
def dq_summary(spark, sf):
    """Violation counts per rule for the evaluation stage."""
    return Q.violation_summary(dq_evaluation(spark, sf))
