"""Registered queries in which every row rule fires: stage tables derived from
the documents in which a key's remainder says how a row breaks its rules, and
the schema and non-empty checks (V0-V17, F9, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions import text as T
from specgrade.operators import corpus as C
from specgrade.operators import quality as Q
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import WS
from specgrade.plans.tables import table


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", (F.col("doc_id") % 9).alias("r"))


_D = "(SELECT doc_id, coalesce(text, '') AS text, lang, source, doc_id % 9 AS r FROM documents)"


def _case(otherwise, **by):
    """``r`` = n -> the value of ``r<n>``, else ``otherwise``."""
    out = None
    for name, value in by.items():
        cond = F.col("r") == int(name[1:])
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def _stamped(df):
    return df.withColumns({"model_used": F.lit("stub-model"), "timestamp": F.current_timestamp()})


def _lines(n, item):
    """``n`` numbered lines."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(i.cast("string"), F.lit(". "), item)), "\n")


def _lines_sql(n, item):
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda i: CAST(i AS VARCHAR) || '. ' || {item}), chr(10))"


def _raw(spark, sf):
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))
    d = _documents(spark, sf).withColumn("text", _case(F.col("text"), r2=F.lit(" \t")))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", "text",
                    _case(url, r3=F.lit("ftp://example.org"), r4=F.lit(None)).alias("url"),
                    _case(T.char_length("text"), r1=F.lit(0).cast("bigint"), r5=F.lit(None)).alias("text_length"))


_RAW = f"""
SELECT doc_id, CASE WHEN NOT coalesce(text_length > 0, false) THEN 'V1' WHEN trim(text, {WS}) = '' THEN 'V2'
                    WHEN NOT coalesce(regexp_matches(url, '^https?://'), false) THEN 'V3' END AS rule_id
FROM (SELECT doc_id, text, CASE r WHEN 3 THEN 'ftp://example.org' WHEN 4 THEN NULL ELSE 'https://example.org/' || doc_id END AS url,
             CASE r WHEN 1 THEN 0 WHEN 5 THEN NULL ELSE length(text) END AS text_length
      FROM (SELECT doc_id, r, CASE r WHEN 2 THEN ' ' || chr(9) ELSE text END AS text FROM {_D}))
"""


def _merged(spark, sf):
    d = _documents(spark, sf)
    return d.select("doc_id", _case(F.col("text"), r7=F.lit(" \n")).alias("original_blog_1"), F.lit("b").alias("original_blog_2"),
                    _case(F.lit("m"), r8=F.lit(None)).alias("merged_blog"),
                    _case(F.lit(0.5), r1=F.lit(1.5), r2=F.lit(-0.1), r3=F.lit(float("nan")), r4=F.lit(None)).alias("similarity"),
                    _case(F.lit("similar"), r5=F.lit("other"), r6=F.lit(None)).alias("merge_type"))


_MERGED = f"""
SELECT doc_id, CASE WHEN r IN (1, 2, 3, 4) THEN 'V4' WHEN r IN (5, 6) THEN 'V5' WHEN r IN (7, 8) OR trim(text, {WS}) = '' THEN 'V6' END AS rule_id FROM {_D}
"""


def _constraints(spark, sf):
    d = _documents(spark, sf)
    return _stamped(d.select("doc_id", _case(F.col("doc_id") + 1, r1=-F.col("doc_id")).alias("instruction_number"), F.lit("i").alias("instruction"),
                             _case(F.col("source"), r3=F.lit(" \t "), r4=F.lit(None)).alias("main_task"),
                             _case(_lines(F.lit(39), F.col("lang")), r2=_lines(F.lit(38), F.col("lang"))).alias("constraints")))


_CONSTRAINTS = f"""
SELECT doc_id, CASE WHEN r = 1 THEN 'V7' WHEN len(regexp_extract_all(constraints, '(?m)^[0-9]+\\.')) <> 39 THEN 'V8' WHEN r IN (3, 4) THEN 'V9' END AS rule_id
FROM (SELECT doc_id, r, CASE r WHEN 2 THEN {_lines_sql(38, "lang")} ELSE {_lines_sql(39, "lang")} END AS constraints FROM {_D})
"""


def _base(spark, sf):
    n = T.char_length("text")
    return _stamped(_documents(spark, sf).select("doc_id", _case(F.col("doc_id") + 1, r1=F.lit(0).cast("bigint")).alias("instruction_number"), F.lit("t").alias("main_task"),
                                                 F.col("text").alias("base_content"), _case(n, r2=n + 11, r3=n - 11, r4=n + 10).alias("content_length"),
                                                 _case(F.lit(7).cast("bigint"), r5=F.lit(0), r6=F.lit(None)).alias("tokens_used")))


_BASE = f"""
SELECT doc_id, CASE WHEN r = 1 THEN 'V7' WHEN r IN (2, 3) OR n <= 0 THEN 'V10' WHEN r IN (5, 6) THEN 'V11' END AS rule_id
FROM (SELECT doc_id, r, CASE r WHEN 4 THEN length(text) + 10 ELSE length(text) END AS n FROM {_D})
"""


def _fitted(spark, sf):
    n = T.char_length("text")
    return _stamped(_documents(spark, sf).select("doc_id", _case(F.col("doc_id") + 1, r1=F.lit(None)).alias("instruction_number"), F.lit("t").alias("main_task"),
                                                 F.lit("c").alias("constraints"), F.lit("b").alias("base_content"), F.col("text").alias("fitted_content"),
                                                 _case(n, r4=n + 11, r5=F.lit(None)).alias("fitted_length"),
                                                 _case(F.lit(39), r2=F.lit(38), r3=F.lit(None)).alias("num_constraints"), F.lit(1).alias("tokens_used")))


_FITTED = f"""
SELECT doc_id, CASE WHEN r = 1 THEN 'V7' WHEN r IN (2, 3) THEN 'V12' WHEN r IN (4, 5) OR length(text) = 0 THEN 'V13' END AS rule_id FROM {_D}
"""


def _evaluation(spark, sf):
    rate = F.lit(20) / F.lit(39)
    return _stamped(_documents(spark, sf).select(
        "doc_id", (F.col("doc_id") + 1).alias("instruction_number"), F.lit("f").alias("fitted_content"), F.lit("c").alias("constraints"),
        _case(_lines(F.lit(39), F.lit("Yes - stated")), r6=_lines(F.lit(38), F.lit("No - absent")), r7=_lines(F.lit(39), F.lit("Maybe"))).alias("satisfaction_results"),
        _case(F.lit(20), r2=F.lit(40), r3=F.lit(-1)).alias("num_satisfied"), _case(F.lit(39), r1=F.lit(38)).alias("total_constraints"),
        _case(rate, r4=rate + 0.02, r5=F.lit(None), r8=rate + 0.009).alias("satisfaction_rate"), F.lit(1).alias("tokens_used")))


_EVALUATION = f"""
SELECT doc_id, CASE WHEN r = 1 THEN 'V14' WHEN r IN (2, 3) THEN 'V15' WHEN r IN (4, 5) THEN 'V16' WHEN r IN (6, 7) THEN 'V17' END AS rule_id FROM {_D}
"""

STAGES = {"raw_blogs": (_raw, _RAW), "merged": (_merged, _MERGED), "constraints": (_constraints, _CONSTRAINTS), "base_generated": (_base, _BASE),
          "fitted": (_fitted, _FITTED), "evaluation": (_evaluation, _EVALUATION)}


def _register(stage, build, sql):
    def run(spark, sf):
        return Q.validate(build(spark, sf), stage, "doc_id").select("doc_id", "rule_id")
    rules = ", ".join(sorted({part for part in sql.split("'") if part[:1] == "V" and part[1:].isdigit()}, key=lambda v: int(v[1:])))
    run.__doc__ = f"{rules}: each broken by some rows of a {stage} table."
    query(f"dq_{stage}_broken", f"SELECT * FROM ({sql}) WHERE rule_id IS NOT NULL")(run)


for _stage, (_build, _sql) in STAGES.items():
    _register(_stage, _build, _sql)


@query("dq_rule_counts", "SELECT stage, rule_id, count(*) AS n_violations FROM (" + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, rule_id FROM ({sql})" for stage, (_, sql) in STAGES.items()) + ") WHERE rule_id IS NOT NULL GROUP BY ALL")
def dq_rule_counts(spark, sf):
    """Violations per stage and rule; no rule is without rows."""
    out = None
    for stage, (build, _) in STAGES.items():
        found = Q.violation_summary(Q.validate(build(spark, sf), stage, "doc_id")).select(F.lit(stage).alias("stage"), "rule_id", "n_violations")
        out = found if out is None else out.unionByName(found)
    return out


@query("nonempty_rows", "SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 9 NOT IN (1, 2, 3)")
def nonempty_rows(spark, sf):
    """rows whose url or text is null or empty go."""
    d = _documents(spark, sf)
    d = d.select("doc_id", _case(F.col("text"), r1=F.lit("")).alias("text"), _case(F.lit("u"), r2=F.lit(None), r3=F.lit("")).alias("url"))
    return C.require_nonempty(d, "url", "text").select("doc_id")


@query("schema_report", """
WITH n AS (SELECT count(doc_id) AS id, count(source) AS source, count(text) AS text, count(n_chars) AS n_chars, count(lang) AS lang FROM documents)
SELECT 'id' AS name, 'required' AS status, id AS n_values FROM n UNION ALL SELECT 'source', 'required', source FROM n
UNION ALL SELECT 'text', 'required', text FROM n UNION ALL SELECT 'text_length', 'required', n_chars FROM n
UNION ALL SELECT 'url', 'missing', NULL UNION ALL SELECT 'created', 'optional, absent', NULL UNION ALL SELECT 'added', 'optional', id FROM n
UNION ALL SELECT 'lang', 'unknown', lang FROM n
""")
def schema_report(spark, sf):
    """V0+J9: the documents held against the raw_blogs schema: a required
    column is missing, an optional one absent, one unknown."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", "text", F.col("n_chars").alias("text_length"),
                                             "lang", F.lit("2024-02-01").alias("added"))
    return Q.schema_report(d, "raw_blogs")
