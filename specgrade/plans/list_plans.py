"""Registered queries for numbered-list parsing and bucket expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions import lists as L
from specgrade.operators import lists as OL
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import (inline_segments_sql, CONSTRAINTS_TEXT, TASK_RESPONSES, WS,
                                      parse_numbered_sql)
from specgrade.plans.tables import constraints_text, table, task_responses

_ITEMS = parse_numbered_sql("constraints")


@query("parse_numbered", f"""
SELECT instruction_number, CAST(i AS BIGINT) AS idx, items[i] AS constraint
FROM (SELECT instruction_number, {_ITEMS} AS items FROM {CONSTRAINTS_TEXT}) t,
     LATERAL (SELECT unnest(generate_series(1, len(items))) AS i)
""")
def parse_numbered(spark, sf):
    """T1+T11: constraint lists parsed and exploded to (key, idx, constraint)."""
    return OL.explode_constraints(constraints_text(spark, sf), "instruction_number")


@query("explode_constraints", f"""
SELECT instruction_number, CAST(i AS BIGINT) AS idx, items[i] AS constraint
FROM (SELECT instruction_number, {parse_numbered_sql("text")} AS items FROM (SELECT doc_id AS instruction_number, text FROM documents)) t,
     LATERAL (SELECT unnest(generate_series(1, len(items))) AS i)
""")
def explode_constraints(spark, sf):
    """T1+T11 on raw documents: text before item 1 becomes an item (Q10),
    embedded 'n.' after a newline splits items."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"), "text")
    return OL.explode_constraints(d, "instruction_number", text="text")


@query("parse_inline", f"""
SELECT doc_id, pos, segment FROM {inline_segments_sql("documents", "doc_id", "text")}
""")
def parse_inline(spark, sf):
    """T2 segment parser over documents (oracle: a recursive scan, since RE2
    lacks look-ahead)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(L.parse_numbered_inline("text")).alias("pos", "segment"))


@query("take_constraints", f"""
SELECT instruction_number,
       coalesce(array_to_string(list_transform(({_ITEMS})[1:23], lambda x, i: i || '. ' || x), chr(10)), '') AS top_constraints
FROM {CONSTRAINTS_TEXT}
""")
def take_constraints(spark, sf):
    """First 23 constraints renumbered."""
    c = constraints_text(spark, sf)
    return c.select("instruction_number",
                    L.take_constraints(L.parse_numbered("constraints"), 23).alias("top_constraints"))


@query("count_numbered", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[0-9]+\\.')) AS BIGINT) AS n_numbered FROM documents
""")
def count_numbered(spark, sf):
    """T4: lines that start with 'digits.' in column 0."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", L.count_numbered("text").alias("n_numbered"))


@query("count_digit_lines", f"""
SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})),
       lambda x: x <> '' AND NOT starts_with(x, 'Constraint') AND regexp_matches(x, '^[0-9]'))) AS BIGINT) AS n_digit_lines
FROM documents
""")
def count_digit_lines(spark, sf):
    """T5: trimmed lines starting with a digit (looser than T4)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", L.count_digit_lines("text").alias("n_digit_lines"))


def _lines_sql(expr):
    return f"list_transform(string_split(trim({expr}, {WS}), chr(10)), lambda x: trim(x, {WS}))"


_L = _lines_sql("response")
_POS = f"list_position(list_transform({_L}, lambda x: starts_with(x, 'Constraints:')), true)"


@query("split_task", f"""
SELECT instruction_number,
       coalesce(trim(replace(list_filter({_L}, lambda x: starts_with(x, 'Main Task:'))[-1], 'Main Task:', ''), {WS}), '') AS main_task,
       coalesce(CASE WHEN {_POS} IS NULL OR {_POS} = 0 THEN '' ELSE array_to_string(list_filter(({_L})[{_POS} + 1:],
                lambda x: x <> '' AND NOT starts_with(x, 'Main Task:') AND NOT starts_with(x, 'Constraints:')), chr(10)) END, '') AS constraints
FROM {TASK_RESPONSES}
""")
def split_task(spark, sf):
    """Strict Main Task / Constraints split of generation responses."""
    r = task_responses(spark, sf)
    return L.with_task_split(r, "response", "s").select(
        "instruction_number", "s.main_task", "s.constraints")


_LL = f"list_transform({_L}, lambda x: trim(regexp_replace(x, '^\\*+|\\*+$', '', 'g'), {WS}))"
_TASK = "contains(lower(x), 'main task')"
_CONS = "(contains(lower(x), 'constraints') AND NOT contains(lower(x), 'main task'))"
_LPOS = f"list_position(list_transform({_LL}, lambda x: {_CONS}), true)"
_LAST = f"list_filter({_LL}, lambda x: {_TASK})[-1]"


@query("split_task_lenient", f"""
SELECT instruction_number,
       coalesce(CASE WHEN contains({_LAST}, ':') THEN trim(substr({_LAST}, strpos({_LAST}, ':') + 1), {WS})
                     ELSE trim(replace({_LAST}, 'main task', ''), {WS}) END, '') AS main_task,
       coalesce(CASE WHEN {_LPOS} IS NULL OR {_LPOS} = 0 THEN '' ELSE array_to_string(list_filter(({_LL})[{_LPOS} + 1:],
                lambda x: x <> '' AND NOT {_TASK} AND NOT {_CONS}), chr(10)) END, '') AS constraints
FROM (SELECT instruction_number, replace(response, 'Main Task:', '**Main Task:**') AS response FROM {TASK_RESPONSES})
""")
def split_task_lenient(spark, sf):
    """Lenient split of responses with '**Main Task:**' headings."""
    r = task_responses(spark, sf).withColumn(
        "response", F.replace("response", F.lit("Main Task:"), F.lit("**Main Task:**")))
    return L.with_task_split(r, "response", "s", lenient=True).select(
        "instruction_number", "s.main_task", "s.constraints")


@query("extract_main_task", f"""
SELECT instruction_number,
       trim(regexp_extract(response, '(?s)Main Task\\s*:\\s*(.*?)\\s*(?:Constraints\\s*:|$)', 1), {WS}) AS main_task,
       trim(regexp_extract(response, '(?s)Constraints\\s*:\\s*(.*)', 1), {WS}) AS constraints
FROM {TASK_RESPONSES}
""")
def extract_main_task(spark, sf):
    """Dot-all regex split (task up to 'Constraints:' or the end)."""
    r = task_responses(spark, sf)
    return r.select("instruction_number", L.extract_main_task("response").alias("s")).select(
        "instruction_number", "s.main_task", "s.constraints")


@query("empty_parse", f"""
SELECT instruction_number FROM {TASK_RESPONSES}
WHERE coalesce(CASE WHEN {_POS} IS NULL OR {_POS} = 0 THEN '' ELSE array_to_string(list_filter(({_L})[{_POS} + 1:],
                lambda x: x <> '' AND NOT starts_with(x, 'Main Task:') AND NOT starts_with(x, 'Constraints:')), chr(10)) END, '') = ''
""")
def empty_parse(spark, sf):
    """Responses whose parsed constraint list is empty (quarantine)."""
    r = L.with_task_split(task_responses(spark, sf), "response", "s")
    return r.filter(L.empty_parse_flag("s.constraints")).select("instruction_number")


_SIZES = "(VALUES (7), (15), (23), (31), (39)) AS s(size)"


@query("expand_buckets", f"""
SELECT instruction_number, CAST(least(size, len(items)) AS INTEGER) AS subset_size,
       coalesce(array_to_string(list_transform(items[1:size], lambda x, i: i || '. ' || x), chr(10)), '') AS selected_constraints
FROM (SELECT instruction_number, {_ITEMS} AS items FROM {CONSTRAINTS_TEXT}) CROSS JOIN {_SIZES}
""")
def expand_buckets(spark, sf):
    """Each constraint list x bucket sizes 7/15/23/31/39."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    return OL.expand_buckets(c).select("instruction_number", "subset_size", "selected_constraints")


@query("bucket_counts", f"""
SELECT CAST(size AS INTEGER) AS size, count(*) FILTER (WHERE least(s2.size2, len(items)) = size) AS n_rows
FROM {_SIZES}
CROSS JOIN (SELECT {_ITEMS} AS items FROM {CONSTRAINTS_TEXT})
CROSS JOIN (VALUES (7), (15), (23), (31), (39)) AS s2(size2)
GROUP BY size
""")
def bucket_counts(spark, sf):
    """Expanded rows per requested bucket size."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    return OL.bucket_counts(OL.expand_buckets(c))


@query("dup_constraints", f"""
SELECT instruction_number,
       CAST(len(items) - len(list_distinct(list_transform(items, lambda x: lower(trim(x, {WS}))))) AS BIGINT) AS n_duplicates
FROM (SELECT instruction_number, {_ITEMS} AS items FROM {CONSTRAINTS_TEXT})
""")
def dup_constraints(spark, sf):
    """Repeated constraints inside one list (after normalisation)."""
    c = constraints_text(spark, sf)
    return c.select("instruction_number", L.duplicate_items(L.parse_numbered("constraints")).alias("n_duplicates"))


@query("expansion_factor", f"""
SELECT count(*) AS rows_in, count(*) * 5 AS rows_out, CAST(5.0 AS DOUBLE) AS expansion_factor FROM {CONSTRAINTS_TEXT}
""")
def expansion_factor(spark, sf):
    """Rows in / rows out / factor of the 5-size bucket expansion."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    return OL.expansion_factor(c, OL.expand_buckets(c))
