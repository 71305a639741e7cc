"""Registered end-to-end model stages (B5-B11, B14, B15, B17) on responses
derived from the driver tables (an offline response file in the reference's
terms), plus the stage-table quality checks that need them (V4-V6, V12-V13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specgrade.functions import lists as L
from specgrade.functions import scoring as S
from specgrade.functions import text as T
from specgrade.operators import inference as I
from specgrade.operators import lists as OL
from specgrade.operators import pairing as P
from specgrade.operators import quality as Q
from specgrade.operators import stages as SG
from specgrade.plans.pairing_plans import SCORED_SQL
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import (CONSTRAINTS_TEXT, DOC_LINES, TASK_RESPONSES, WS, pair_scores_sql,
                                      parse_numbered_sql, word_count_sql)
from specgrade.plans.tables import (constraints_text, numbered_lines, pair_eval_text, satisfaction_text, table,
                                    task_responses)
from specgrade.session import ensure_checkpoint_dir
from specgrade.sources.ledger import BatchLedger


# B5 ----------------------------------------------------------------------
def _merge_stage(spark, sf):
    e = table(spark, sf, "embeddings")
    cand = P.band_pairs(P.score_edges(P.sampled_candidates(e, "vec_id"), e), 0.30, 0.50)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = P.attach_pair_text(cand.select(F.col("i").alias("blog_1_id"), F.col("j").alias("blog_2_id"),
                                           "similarity"), docs, "doc_id")
    pairs = pairs.withColumn("pair_id", F.concat_ws("-", F.col("blog_1_id").cast("string"), F.col("blog_2_id").cast("string")))
    answers = pairs.select("pair_id", F.concat_ws("\n\n", F.coalesce("blog_1_text", F.lit("")),
                                                  F.coalesce("blog_2_text", F.lit(""))).alias("text"), F.when((F.col("blog_1_id") + F.col("blog_2_id")) % 4 == 0,
                                                  F.lit("Timeout")).alias("error"))
    resp = I.offline_responses(answers, "pair_id", "text", "error", stage="merge")
    return SG.merge_results(pairs, resp, "pair_id", band=(0.40, 0.50))


_MERGE_SQL = f"""
  (SELECT pair_id, blog_1_id, blog_2_id, similarity, t1, t2,
          CASE WHEN similarity BETWEEN 0.40 AND 0.50 THEN 'dissimilar' ELSE 'similar' END AS merge_type,
          CASE WHEN failed THEN '' ELSE coalesce(t1, '') || chr(10) || chr(10) || coalesce(t2, '') END AS merged_blog,
          CASE WHEN failed THEN 'Timeout' END AS error
   FROM (SELECT CAST(c.i AS VARCHAR) || '-' || CAST(c.j AS VARCHAR) AS pair_id, c.i AS blog_1_id, c.j AS blog_2_id, c.similarity,
                d1.text AS t1, d2.text AS t2, (c.i + c.j) % 4 = 0 AS failed
         FROM {SCORED_SQL} c LEFT JOIN documents d1 ON d1.doc_id = c.i LEFT JOIN documents d2 ON d2.doc_id = c.j
         WHERE c.similarity BETWEEN 0.30 AND 0.50))
"""


@query("merge_stage", f"""
SELECT pair_id, blog_1_id, blog_2_id, similarity, merge_type, CAST(length(merged_blog) AS BIGINT) AS merged_length,
       CAST(CASE WHEN error IS NULL THEN {word_count_sql('merged_blog')} ELSE 0 END AS BIGINT) AS tokens_used, error
FROM {_MERGE_SQL}
""", round_cols=('similarity',))
def merge_stage(spark, sf):
    """In-band candidate pairs merged (offline answers; every 4th fails)."""
    return _merge_stage(spark, sf).select("pair_id", "blog_1_id", "blog_2_id", "similarity", "merge_type",
                                          "merged_length", "tokens_used", "error")


@query("dq_merged", f"""
SELECT pair_id, rule_id FROM (
  SELECT pair_id,
         CASE WHEN NOT coalesce(similarity BETWEEN 0.0 AND 1.0, false) THEN 'V4'
              WHEN NOT coalesce(merge_type IN ('similar', 'dissimilar'), false) THEN 'V5'
              WHEN coalesce(trim(t1, {WS}), '') = '' OR coalesce(trim(t2, {WS}), '') = ''
                   OR coalesce(trim(merged_blog, {WS}), '') = '' THEN 'V6' END AS rule_id
  FROM {_MERGE_SQL})
WHERE rule_id IS NOT NULL
""")
def dq_merged(spark, sf):
    """V4-V6 on the merge stage: failed merges have an empty merged text."""
    return Q.validate(_merge_stage(spark, sf), "merged", "pair_id").select("pair_id", "rule_id")


# B6 / B7 -----------------------------------------------------------------
def _task_resp(spark, sf, lenient=False):
    r = task_responses(spark, sf)
    if lenient:
        r = r.withColumn("response", F.replace("response", F.lit("Main Task:"), F.lit("**Main Task:**")))
    r = r.withColumn("error", F.when(F.col("instruction_number") % 11 == 0, F.lit("Timeout")))
    return I.offline_responses(r, "instruction_number", "response", "error", stage="constraints")


def _lines_sql(expr):
    return f"list_transform(string_split(trim({expr}, {WS}), chr(10)), lambda x: trim(x, {WS}))"


_L = _lines_sql("response")
_POS = f"list_position(list_transform({_L}, lambda x: starts_with(x, 'Constraints:')), true)"
_TASK = f"coalesce(trim(replace(list_filter({_L}, lambda x: starts_with(x, 'Main Task:'))[-1], 'Main Task:', ''), {WS}), '')"
_CONS = (f"coalesce(CASE WHEN {_POS} IS NULL OR {_POS} = 0 THEN '' ELSE array_to_string(list_filter(({_L})[{_POS} + 1:], "
         f"lambda x: x <> '' AND NOT starts_with(x, 'Main Task:') AND NOT starts_with(x, 'Constraints:')), chr(10)) END, '')")


@query("constraints_stage", f"""
SELECT r.instruction_number, d.text AS instruction,
       CASE WHEN failed THEN '' ELSE {_TASK} END AS main_task,
       CASE WHEN failed THEN '' ELSE {_CONS} END AS constraints,
       CASE WHEN failed THEN true ELSE {_CONS} = '' END AS empty_parse,
       CASE WHEN failed THEN 'Timeout' END AS error
FROM (SELECT *, instruction_number % 11 = 0 AS failed FROM {TASK_RESPONSES}) r
JOIN documents d ON d.doc_id = r.instruction_number
""")
def constraints_stage(spark, sf):
    """Generation responses parsed into task + constraints."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                                F.col("text").alias("merged_blog"))
    out = SG.constraints_results(docs, _task_resp(spark, sf), "instruction_number")
    return out.select("instruction_number", "instruction", "main_task", "constraints", "empty_parse", "error")


def _lenient_sql():
    from specgrade.plans import list_plans as LP
    task = (f"coalesce(CASE WHEN contains({LP._LAST}, ':') THEN trim(substr({LP._LAST}, strpos({LP._LAST}, ':') + 1), {WS}) "
            f"ELSE trim(replace({LP._LAST}, 'main task', ''), {WS}) END, '')")
    cons = (f"coalesce(CASE WHEN {LP._LPOS} IS NULL OR {LP._LPOS} = 0 THEN '' ELSE array_to_string(list_filter(({LP._LL})[{LP._LPOS} + 1:], "
            f"lambda x: x <> '' AND NOT {LP._TASK} AND NOT {LP._CONS}), chr(10)) END, '')")
    return f"""
SELECT instruction_number, blog1, blog2, CASE WHEN failed THEN '' ELSE {task} END AS main_task,
       CASE WHEN failed THEN '' ELSE {cons} END AS constraints,
       CASE WHEN failed THEN true ELSE {cons} = '' END AS empty_parse,
       CASE WHEN failed THEN 'Timeout' END AS error
FROM (SELECT instruction_number, replace(response, 'Main Task:', '**Main Task:**') AS response,
             instruction_number % 11 = 0 AS failed, d.text AS blog1, d.lang AS blog2
      FROM {TASK_RESPONSES} t JOIN documents d ON d.doc_id = t.instruction_number)
"""


@query("common_constraints_stage", _lenient_sql())
def common_constraints_stage(spark, sf):
    """The lenient parser (T8) on '**Main Task:**' responses."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                                F.col("text").alias("blog_1_text"), F.col("lang").alias("blog_2_text"))
    out = SG.constraints_results(docs, _task_resp(spark, sf, lenient=True), "instruction_number", lenient=True)
    return out.select("instruction_number", "blog1", "blog2", "main_task", "constraints", "empty_parse", "error")


# B8 ----------------------------------------------------------------------
_ITEMS = parse_numbered_sql("constraints")
_BUCKETS = f"""(SELECT instruction_number, size, items FROM (SELECT instruction_number, {_ITEMS} AS items
                 FROM {CONSTRAINTS_TEXT}) CROSS JOIN (VALUES (7), (15), (23), (31), (39)) AS s(size))"""


def _bucketed(spark, sf):
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    b = OL.expand_buckets(c).drop("constraints").withColumnRenamed("selected_constraints", "constraints")
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                                F.col("lang").alias("main_task"))
    return b.join(lang, "instruction_number")


def _base_stage(spark, sf):
    b = _bucketed(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"), "text")
    answers = docs.withColumn("error", F.when(F.col("instruction_number") % 13 == 0, F.lit("Timeout")))
    resp = I.offline_responses(answers, "instruction_number", "text", "error", stage="base")
    return SG.base_results(b, resp, "instruction_number")


@query("base_stage", f"""
SELECT b.instruction_number, CAST(least(size, len(items)) AS INTEGER) AS subset_size,
       CAST(CASE WHEN b.instruction_number % 13 = 0 THEN 0 ELSE length(d.text) END AS BIGINT) AS content_length,
       CASE WHEN b.instruction_number % 13 = 0 THEN 'Timeout' END AS error
FROM {_BUCKETS} b JOIN documents d ON d.doc_id = b.instruction_number
""")
def base_stage(spark, sf):
    """One generation per key for the bucketed rows, replicated."""
    return _base_stage(spark, sf).select("instruction_number", "subset_size", "content_length", "error")


@query("base_requests", "SELECT count(DISTINCT doc_id) AS n_requests FROM documents")
def base_requests(spark, sf):
    """Requests issued for the 5x bucketed rows (one per key)."""
    return SG.base_requests(_bucketed(spark, sf), "instruction_number").agg(
        F.count(F.lit(1)).alias("n_requests"))


# B9 ----------------------------------------------------------------------
def _fit_stage(spark, sf):
    b = _bucketed(spark, sf).withColumn("request_key", F.concat_ws(":", F.col("instruction_number").cast("string"), F.col("subset_size").cast("string")))
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                                F.col("text").alias("base_content"), F.col("lang").alias("main_task"))
    answers = (b.join(base.select("instruction_number", "base_content"), "instruction_number")
                .select("request_key", F.concat_ws("\n\n", "constraints", "base_content").alias("text"),
                        F.when(F.col("instruction_number") % 17 == 0, F.lit("Timeout")).alias("error")))
    resp = I.offline_responses(answers, "request_key", "text", "error", stage="fit")
    return SG.fit_results(b, base, resp, "instruction_number", response_key="request_key", order="main_task")


_SEL = "coalesce(array_to_string(list_transform(items[1:size], lambda x, i: i || '. ' || x), chr(10)), '')"


@query("fit_stage", f"""
SELECT b.instruction_number, CAST(least(size, len(items)) AS INTEGER) AS subset_size,
       CAST(CASE WHEN b.instruction_number % 17 = 0 THEN 0 ELSE length({_SEL} || chr(10) || chr(10) || d.text) END AS BIGINT) AS fitted_length,
       CAST(CASE WHEN b.instruction_number % 17 = 0 THEN 0 ELSE len(regexp_extract_all({_SEL}, '(?m)^[0-9]+\\.')) END AS INTEGER) AS num_constraints,
       CASE WHEN b.instruction_number % 17 = 0 THEN 'Timeout' END AS error
FROM {_BUCKETS} b JOIN documents d ON d.doc_id = b.instruction_number
""")
def fit_stage(spark, sf):
    """Bucketed constraints x base (right side deduped), fitted text per bucket."""
    return _fit_stage(spark, sf).select("instruction_number", "subset_size", "fitted_length", "num_constraints",
                                        "error")


@query("dq_fitted", f"""
SELECT instruction_number, CAST(least(size, len(items)) AS INTEGER) AS subset_size, rule_id FROM (
  SELECT *, CASE WHEN instruction_number <= 0 THEN 'V7'
                 WHEN CASE WHEN instruction_number % 17 = 0 THEN 0 ELSE len(regexp_extract_all({_SEL}, '(?m)^[0-9]+\\.')) END
                      <> least(size, len(items)) THEN 'V12'
                 WHEN instruction_number % 17 = 0 THEN 'V13' END AS rule_id
  FROM {_BUCKETS})
WHERE rule_id IS NOT NULL
""")
def dq_fitted(spark, sf):
    """V7, V12 (per-row bucket size, Q13) and V13 on the fit stage."""
    return _dq_fitted(spark, sf)


def _dq_fitted(spark, sf):
    f = _fit_stage(spark, sf)
    rules = Q.fitted_rules(f, n=None)
    first = F.coalesce(*[F.when(~r.ok, F.lit(r.id)) for r in rules])
    return f.select("instruction_number", "subset_size", first.alias("rule_id")).filter(F.col("rule_id").isNotNull())


# B10 ---------------------------------------------------------------------
@query("fit_direct_stage", f"""
SELECT c.instruction_number,
       CASE WHEN c.instruction_number % 7 = 0 THEN NULL ELSE CAST(length(d.text || chr(10) || '[fitted]') AS BIGINT) END AS fitted_length,
       CASE WHEN c.instruction_number % 7 = 0 THEN NULL ELSE CAST(length(d.text) AS BIGINT) END AS original_length,
       CASE WHEN c.instruction_number % 7 = 0 THEN NULL ELSE CAST(len(list_filter(list_transform(string_split(c.constraints, chr(10)), lambda x: trim(x, {WS})),
            lambda x: x <> '' AND NOT starts_with(x, 'Constraint') AND regexp_matches(x, '^[0-9]'))) AS BIGINT) END AS num_constraints,
       CASE WHEN c.instruction_number % 7 = 0 THEN d.text ELSE d.text || chr(10) || '[fitted]' END = d.text AS kept_original,
       CASE WHEN c.instruction_number % 7 = 0 THEN 'Timeout' END AS error
FROM {CONSTRAINTS_TEXT} c JOIN documents d ON d.doc_id = c.instruction_number
""")
def fit_direct_stage(spark, sf):
    """Fit onto the merged text; failures keep the original (Q18)."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    merged = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                                  F.col("text").alias("merged_blog"))
    answers = merged.select("instruction_number", F.concat("merged_blog", F.lit("\n[fitted]")).alias("text"),
                            F.when(F.col("instruction_number") % 7 == 0, F.lit("Timeout")).alias("error"))
    resp = I.offline_responses(answers, "instruction_number", "text", "error", stage="fit_direct")
    out = SG.fit_direct_results(c, merged, resp, "instruction_number")
    return out.select("instruction_number", "fitted_length", "original_length", "num_constraints",
                      (F.col("fitted_content") == F.col("merged_blog_original")).alias("kept_original"), "error")


# B11 ---------------------------------------------------------------------
def _revise_sql():
    from specgrade.operators.stages import TEMPLATES
    from specgrade.plans.sqlparts import CONSTRAINTS_TEXT, inline_segments_sql
    tmpl = TEMPLATES["revise"].replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"""
WITH c AS (SELECT * FROM {CONSTRAINTS_TEXT}),
seg AS (SELECT * FROM {inline_segments_sql("c", "instruction_number", "constraints")}),
top AS (SELECT instruction_number,
               string_agg(CAST(pos + 1 AS VARCHAR) || '. ' || segment, chr(10) ORDER BY pos) AS top, count(*) AS n
        FROM seg WHERE pos < 23 GROUP BY instruction_number)
SELECT 'revise:' || CAST(c.instruction_number AS VARCHAR) || ':1' AS request_id,
       CAST(c.instruction_number AS BIGINT) AS key,
       CAST(length(replace(replace(replace('{tmpl}', '{{content}}', c.content),
                                   '{{constraints}}', coalesce(top.top, '')), '{{n}}', CAST(coalesce(top.n, 0) AS VARCHAR))) AS BIGINT) AS prompt_length
FROM c LEFT JOIN top ON top.instruction_number = c.instruction_number
WHERE length(trim(coalesce(c.content, ''), {WS})) > 0
"""


@query("revise_requests", _revise_sql())
def revise_requests(spark, sf):
    """Revision prompts with the first 23 inline-parsed constraints;
    documents without text get no request (oracle: recursive segment scan)."""
    c = constraints_text(spark, sf)
    r = SG.revise_requests(c, "instruction_number", "content", "constraints", 23)
    return r.select("request_id", "key", T.char_length(F.col("messages")[0]["content"]).alias("prompt_length"))


# B14 ---------------------------------------------------------------------
_RESP_REPLACE = f"""
  (SELECT instruction_number, 'Main Task: new ' || lang || chr(10) || 'Revised Constraints:' || chr(10) ||
          coalesce(array_to_string(list_transform({DOC_LINES}, lambda x, i: i || '. ' ||
                   CASE WHEN length(x) % 2 = 0 THEN 'new ' || x ELSE x END), chr(10)), '') AS response
   FROM (SELECT doc_id AS instruction_number, lang, text FROM documents))
"""


@query("replace_stage", f"""
SELECT instruction_number, CASE WHEN failed THEN old_task ELSE new_task END AS main_task, old_constraints AS original_constraints,
       CASE WHEN failed THEN '' ELSE revised_constraints END AS revised_constraints, base AS base_content,
       CASE WHEN failed THEN 'Timeout' END AS error
FROM (SELECT instruction_number, {_CONS.replace("starts_with(x, 'Constraints:')", "(starts_with(x, 'Constraints:') OR starts_with(x, 'Revised Constraints:'))")} AS revised_constraints,
       r.instruction_number % 19 = 0 AS failed, d.lang AS old_task, c.constraints AS old_constraints, d.text AS base,
       {_TASK} AS new_task
FROM {_RESP_REPLACE} r JOIN {CONSTRAINTS_TEXT} c USING (instruction_number) JOIN documents d ON d.doc_id = instruction_number)
""")
def replace_stage(spark, sf):
    """Constraints x base x evaluation (J2), revised lists parsed with
    the 'Revised Constraints:' marker (T7); satisfied items are rewritten."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    d = table(spark, sf, "documents")
    base = d.select(F.col("doc_id").alias("instruction_number"), F.col("lang").alias("main_task"),
                    F.col("text").alias("base_content"))
    ev = satisfaction_text(spark, sf).select("instruction_number", "satisfaction_results")
    reqs = SG.replace_requests(c, base, ev)
    items = numbered_lines(F.col("text"))
    body = F.array_join(F.transform(items, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.when(F.length(x) % 2 == 0, F.concat(F.lit("new "), x)).otherwise(x))), "\n")
    answers = d.select(F.col("doc_id").alias("instruction_number"), F.concat(
        F.lit("Main Task: new "), F.col("lang"), F.lit("\nRevised Constraints:\n"), body).alias("text"),
        F.when(F.col("doc_id") % 19 == 0, F.lit("Timeout")).alias("error"))
    resp = I.offline_responses(answers, "instruction_number", "text", "error", stage="replace")
    asked = c.join(base, "instruction_number").join(reqs.select(F.col("key").alias("instruction_number")), "instruction_number")
    out = SG.replace_results(asked, resp)
    return out.select("instruction_number", "main_task", "original_constraints", "revised_constraints", "base_content",
                      "error")


# B15 / A16 ---------------------------------------------------------------
def _pairwise_stage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("btext"))
    reqs = SG.pairwise_requests(d, b, ["doc_id"], ["item_id"], "text", "btext", seed=42)
    ev = pair_eval_text(spark, sf).select((F.col("instruction_number") + 1).alias("position"), "evaluation")
    resp = I.offline_responses(ev, "position", "evaluation", stage="pairwise")
    pairs = reqs.select(F.col("key").alias("position"))
    order = reqs.select(F.col("key").alias("position"), S.ab_order("key", 42).alias("order"))
    return SG.pairwise_results(pairs.join(order, "position"), resp, "position")


def _pairwise_sql():
    from specgrade.functions.hashing import mix_sql
    order = f"CAST({mix_sql('position', '0', 42)} % 2 AS INTEGER)"
    return f"""
  (SELECT p.position, {order} AS "order", s.* EXCLUDE (instruction_number)
   FROM (SELECT row_number() OVER (ORDER BY item_id) AS position FROM benchmark) p
   JOIN {pair_scores_sql('fixed')} s ON s.instruction_number = p.position - 1)
"""


@query("pairwise_stage", f"""
SELECT position, "order", needs_parsing, grammar_score_A, grammar_score_B, overall_pref FROM {_pairwise_sql()}
""")
def pairwise_stage(spark, sf):
    """Documents zipped with benchmark items, seeded A/B order, scores parsed."""
    return _pairwise_stage(spark, sf).select("position", "order", "needs_parsing", "grammar_score_A",
                                             "grammar_score_B", "overall_pref")


# Attempts decided by the parse ------------------------------
def _pairwise_answers(spark, sf):
    """Answers of three attempts: by doc_id % 4 the first, second, third or
    none of them has scores; attempt 1 of every 11th fails in transport."""
    ev = pair_eval_text(spark, sf).filter(F.col("instruction_number") % 7 != 6)  # layouts with scores
    a = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")
    rows = ev.select(F.col("instruction_number").alias("key"), "evaluation", a)
    parses = F.col("key") % 4 == F.col("attempt") - 1
    failed = (F.col("attempt") == 1) & (F.col("key") % 11 == 0)
    return rows.select(F.concat_ws(":", F.lit("pairwise"), F.col("key").cast("string"), F.col("attempt").cast("string")).alias("request_id"), "key", "attempt",
                       F.when(~failed, F.when(parses, F.col("evaluation")).otherwise(F.concat(F.lit("Attempt "), F.col("attempt").cast("string")))).alias("text"),
                       F.lit(1).cast("bigint").alias("input_tokens"), F.col("attempt").cast("bigint").alias("output_tokens"),
                       F.when(failed, F.lit("RateLimitError")).alias("error"))


@query("pairwise_retry", """
WITH k AS (SELECT doc_id AS key, doc_id % 4 AS r, doc_id % 11 = 0 AS failed FROM documents WHERE doc_id % 7 <> 6),
a AS (SELECT *, CASE WHEN r = 3 OR (r = 0 AND failed) THEN NULL ELSE r + 1 END AS parsed FROM k)
SELECT key, CAST(coalesce(parsed, 3) AS INTEGER) AS attempts, CASE WHEN parsed IS NULL THEN 1 ELSE 0 END AS needs_parsing,
       CASE WHEN parsed IS NULL THEN 'Attempt 3' END AS raw, CAST(1 + coalesce(parsed, 3) AS BIGINT) AS evaluation_tokens FROM a
""")
def pairwise_retry(spark, sf):
    """A18+B3+B15: an answer without scores is asked again, three attempts at
    most, then flagged with its last answer; one that parses is never asked
    again.  The answers are an offline table, read round by round as the
    retry plan asks."""
    offline = _pairwise_answers(spark, sf)
    pairs = offline.select("key").distinct()
    reqs = I.build_requests(pairs, "pairwise", "key", "{k}", {"k": "key"})
    ledger = BatchLedger(spark, ensure_checkpoint_dir(spark).rstrip("/") + f"/specgrade-retry-{uuid.uuid4().hex}")
    for attempt in (1, 2, 3):
        seen = ledger.read()
        due = reqs if seen is None else I.retry_plan(reqs, seen, 3, accept=S.has_pair_scores)
        ledger.write(str(attempt), offline.join(due.select("key", "attempt"), ["key", "attempt"], "left_semi"))
    seen = ledger.read()
    asked = seen.groupBy("key").agg(F.max("attempt").alias("attempts"))
    out = SG.pairwise_results(pairs, seen, "key").join(asked, "key")
    return out.select("key", "attempts", "needs_parsing", F.when(F.col("needs_parsing") == 1, F.col("evaluations_raw")).alias("raw"), "evaluation_tokens")


@query("unswap_scores", f"""
SELECT position, CASE WHEN "order" = 1 THEN grammar_score_B ELSE grammar_score_A END AS grammar_first,
       CASE WHEN "order" = 1 THEN grammar_score_A ELSE grammar_score_B END AS grammar_second
FROM {_pairwise_sql()}
""")
def unswap_scores(spark, sf):
    """Grammar scores mapped back to the source articles by the stored order."""
    p = _pairwise_stage(spark, sf)
    u = S.unswap("order", "grammar_score_A", "grammar_score_B")
    return p.select("position", u["first"].alias("grammar_first"), u["second"].alias("grammar_second"))


# B17 / T7 / T14 / U3 -----------------------------------------------------
_LEG = SG.TEMPLATES["legacy_eval"].replace("\n", "' || chr(10) || '")


@query("legacy_eval_requests", f"""
SELECT 'legacy_eval:' || CAST(doc_id AS VARCHAR) || ':1' AS request_id,
       CAST(length(replace(replace(replace('{_LEG}', '{{story}}', coalesce(text, '')), '{{constraints}}', lang),
            '{{count}}', CAST(n_chars % 40 AS VARCHAR))) AS BIGINT) AS prompt_length
FROM documents
""")
def legacy_eval_requests(spark, sf):
    """The notebook evaluation prompt from legacy-named columns."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("instruction_number"), F.col("text").alias("FinalGeneratedStory"),
        F.col("lang").alias("SelectedConstraints"), (F.col("n_chars") % 40).alias("Number_of_Constraints"))
    r = SG.legacy_eval_requests(d, "instruction_number")
    return r.select("request_id", T.char_length(F.col("messages")[0]["content"]).alias("prompt_length"))


@query("split_task_revised", f"""
SELECT instruction_number, {_TASK} AS main_task,
       {_CONS.replace("starts_with(x, 'Constraints:')", "(starts_with(x, 'Constraints:') OR starts_with(x, 'Revised Constraints:'))")} AS constraints
FROM (SELECT instruction_number, CASE WHEN instruction_number % 2 = 0 THEN replace(response, 'Constraints:', 'Revised Constraints:')
                                      ELSE response END AS response FROM {TASK_RESPONSES})
""")
def split_task_revised(spark, sf):
    """Strict split with the extra 'Revised Constraints:' marker."""
    r = task_responses(spark, sf).withColumn("response", F.when(
        F.col("instruction_number") % 2 == 0, F.replace("response", F.lit("Constraints:"), F.lit("Revised Constraints:")))
        .otherwise(F.col("response")))
    p = L.with_task_split(r, "response", "p", markers=("Constraints:", "Revised Constraints:"))
    return p.select("instruction_number", "p.main_task", "p.constraints")


@query("legacy_expand", f"""
SELECT instruction_number, CAST(least(size, len(items)) AS INTEGER) AS Number_of_Constraints,
       {_SEL} AS SelectedConstraints FROM {_BUCKETS}
""")
def legacy_expand(spark, sf):
    """The notebook expansion on column 'Constraint' with legacy output names."""
    c = constraints_text(spark, sf).select("instruction_number", F.col("constraints").alias("Constraint"))
    out = SG.to_legacy_names(OL.legacy_expand(c))
    return out.select(F.col("Instruction Number").alias("instruction_number"), "Number_of_Constraints",
                      "SelectedConstraints")


@query("usage_normalize", """
SELECT u.conv_id * 100 + u.turn AS key, CAST(len(string_split_regex(trim(a.text), '\\s+')) AS BIGINT) AS input_tokens,
       CAST(0 AS BIGINT) AS output_tokens, CAST(len(string_split_regex(trim(a.text), '\\s+')) AS BIGINT) AS tokens_used
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def usage_normalize(spark, sf):
    """A provider that reports only total_tokens normalised to input/output."""
    from specgrade.plans.tables import conversation_responses
    r = conversation_responses(spark, sf).select("key", T.word_count("text").alias("total_tokens"))
    return I.normalize_usage(r, total_col="total_tokens").select("key", "input_tokens", "output_tokens", "tokens_used")
