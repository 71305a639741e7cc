"""Registered queries for verdict scoring, statistics and pairwise scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions import scoring as S
from specgrade.functions.hashing import mix_sql
from specgrade.operators import stats as ST
from specgrade.operators.lists import DEFAULT_SIZES
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import SATISFACTION_TEXT, pair_scores_sql
from specgrade.plans.tables import pair_eval_text, satisfaction_text

_VRE = "'(?m)^\\s*[0-9]+\\.\\s*(Yes|No)\\b'"
_NUM_YES = f"CAST(len(list_filter(regexp_extract_all(satisfaction_results, {_VRE}, 1), lambda x: x = 'Yes')) AS BIGINT)"
_RATES = f"""(SELECT instruction_number, {_NUM_YES} AS num_satisfied, subset_size AS total_constraints,
                CASE WHEN subset_size > 0 THEN {_NUM_YES} / subset_size ELSE 0.0 END AS satisfaction_rate
         FROM {SATISFACTION_TEXT})"""


def _rates(spark, sf):
    st = satisfaction_text(spark, sf)
    return st.select("instruction_number", S.count_yes("satisfaction_results").alias("num_satisfied"),
                     F.col("subset_size").alias("total_constraints")).withColumn(
        "satisfaction_rate", S.satisfaction_rate("num_satisfied", "total_constraints"))


@query("count_yes", f"SELECT instruction_number, {_NUM_YES} AS num_satisfied FROM {SATISFACTION_TEXT}")
def count_yes(spark, sf):
    """A1: 'n. Yes' verdict lines per evaluation."""
    st = satisfaction_text(spark, sf)
    return st.select("instruction_number", S.count_yes("satisfaction_results").alias("num_satisfied"))


_ROW_RE = "'(?m)^\\s*([0-9]+)\\.\\s*(Yes|No)\\b[ \\t]*-?[ \\t]*([^\\n]*)'"


@query("verdict_rows", f"""
SELECT instruction_number, CAST(n[i] AS BIGINT) AS idx, v[i] AS verdict, trim(r[i]) AS reason
FROM (SELECT instruction_number, regexp_extract_all(satisfaction_results, {_ROW_RE}, 1) AS n,
             regexp_extract_all(satisfaction_results, {_ROW_RE}, 2) AS v,
             regexp_extract_all(satisfaction_results, {_ROW_RE}, 3) AS r FROM {SATISFACTION_TEXT}) t,
     LATERAL (SELECT unnest(generate_series(1, len(n))) AS i)
""")
def verdict_rows(spark, sf):
    """A2: one row per verdict (key, idx, verdict, reason)."""
    st = satisfaction_text(spark, sf)
    return st.select("instruction_number", F.explode(S.verdict_rows("satisfaction_results")).alias("v")).select(
        "instruction_number", "v.idx", "v.verdict", "v.reason")


@query("satisfaction_rate", f"SELECT * FROM {_RATES}")
def satisfaction_rate(spark, sf):
    """A3+A4: num satisfied, total (subset_size) and rate (0.0 when total 0)."""
    return _rates(spark, sf)


@query("satisfaction_summary", f"""
SELECT count(satisfaction_rate) AS n, avg(satisfaction_rate) AS mean_rate, min(satisfaction_rate) AS min_rate,
       max(satisfaction_rate) AS max_rate, stddev_samp(satisfaction_rate) AS std_rate,
       quantile_cont(satisfaction_rate, 0.25) AS p25_rate, quantile_cont(satisfaction_rate, 0.5) AS p50_rate,
       quantile_cont(satisfaction_rate, 0.75) AS p75_rate
FROM {_RATES}
""", round_cols=('mean_rate', 'std_rate', 'p25_rate', 'p50_rate', 'p75_rate'))
def satisfaction_summary(spark, sf):
    """A5: describe() of the satisfaction rate."""
    return ST.describe_rate(_rates(spark, sf))


_SIZES_SQL = ", ".join(f"({s})" for s in DEFAULT_SIZES)


@query("satisfaction_curve", f"""
SELECT CAST(size AS INTEGER) AS size, count(rate) AS n, avg(rate) AS mean_rate, min(rate) AS min_rate,
       max(rate) AS max_rate, stddev_samp(rate) AS std_rate,
       quantile_cont(rate, 0.25) AS p25_rate, quantile_cont(rate, 0.5) AS p50_rate, quantile_cont(rate, 0.75) AS p75_rate
FROM (SELECT size, CASE WHEN least(size, len(v)) > 0
                        THEN len(list_filter(v[1:size], lambda x: x = 'Yes')) / least(size, len(v)) ELSE 0.0 END AS rate
      FROM (SELECT regexp_extract_all(satisfaction_results, {_VRE}, 1) AS v FROM {SATISFACTION_TEXT})
      CROSS JOIN (VALUES {_SIZES_SQL}) AS s(size))
GROUP BY size
""", round_cols=('mean_rate', 'std_rate', 'p25_rate', 'p50_rate', 'p75_rate'))
def satisfaction_curve(spark, sf):
    """Satisfaction vs. bucket size: each evaluation cut to the first
    7/15/23/31/39 verdicts, rate = yes / min(size, total), described per size."""
    st = satisfaction_text(spark, sf)
    v = F.regexp_extract_all("satisfaction_results", F.lit(S.VERDICT_RE), 1)
    per = (st.select(v.alias("v"))
             .withColumn("size", F.explode(F.array(*[F.lit(s) for s in DEFAULT_SIZES])))
             .withColumn("total", F.least("size", F.size("v")))
             .withColumn("yes", F.size(F.filter(F.slice("v", 1, F.col("size")), lambda x: x == "Yes")))
             .withColumn("rate", S.satisfaction_rate("yes", "total")))
    return ST.describe_rate(per, "rate", ["size"]).withColumnsRenamed({})


@query("constraint_difficulty", f"""
SELECT CAST(n[i] AS BIGINT) AS idx, count(*) AS n, avg(CASE WHEN v[i] = 'Yes' THEN 1.0 ELSE 0.0 END) AS yes_share
FROM (SELECT regexp_extract_all(satisfaction_results, {_ROW_RE}, 1) AS n,
             regexp_extract_all(satisfaction_results, {_ROW_RE}, 2) AS v FROM {SATISFACTION_TEXT}) t,
     LATERAL (SELECT unnest(generate_series(1, len(n))) AS i)
GROUP BY 1
""")
def constraint_difficulty(spark, sf):
    """Share of Yes per constraint position."""
    return ST.share_yes(verdict_rows(spark, sf), "idx")


_PS = pair_scores_sql("fixed")
_PSC = pair_scores_sql("compat")


def _pair_scores(spark, sf, mode):
    e = pair_eval_text(spark, sf)
    p = S.with_pair_scores(e, "evaluation", mode, "p").select("instruction_number", "p")
    cols = [f"{c}_score_{x}" for c in ("grammar", "coherence", "likability") for x in "AB"]
    cols += [f"{c}_pref" for c in ("grammar", "coherence", "likability", "overall")]
    return p.select("instruction_number", *[F.col("p." + c).alias(c) for c in cols],
                    F.when(F.col("p").isNull(), 1).otherwise(0).alias("needs_parsing"))


@query("pair_scores", f"SELECT * FROM {_PS}")
def pair_scores(spark, sf):
    """A13/A14/A18 (fixed mode): six scores, four preferences, parse flag."""
    return _pair_scores(spark, sf, "fixed")


@query("pair_scores_compat", f"SELECT * FROM {_PSC}")
def pair_scores_compat(spark, sf):
    """A13 compat mode: reproduces the reference's denominator quirk."""
    return _pair_scores(spark, sf, "compat")


_ORDER = f"CAST({mix_sql('instruction_number', '0', 42)} % 2 AS INTEGER)"


@query("ab_order", f"SELECT instruction_number, {_ORDER} AS ab_order FROM (SELECT doc_id AS instruction_number FROM documents)")
def ab_order(spark, sf):
    """Seeded, partition-independent presentation order per row."""
    e = pair_eval_text(spark, sf)
    return e.select("instruction_number", S.ab_order("instruction_number", 42).alias("ab_order"))


def _winner_sql(c):
    return (f"CASE WHEN needs_parsing = 1 THEN NULL WHEN ({c}_pref = 'A') = (ab_order = 0) "
            f"THEN 'first' ELSE 'second' END")


@query("win_rate", f"""
SELECT count(*) AS n_rows, avg(CAST(needs_parsing AS DOUBLE)) AS parse_failure_rate,
       {', '.join(f"avg(CASE WHEN needs_parsing = 0 THEN CASE WHEN w_{c} = 'first' THEN 1.0 ELSE 0.0 END END) AS {c}_first_win_rate" for c in ("grammar", "coherence", "likability", "overall"))}
FROM (SELECT needs_parsing, {', '.join(_winner_sql(c) + f' AS w_{c}' for c in ("grammar", "coherence", "likability", "overall"))}
      FROM (SELECT p.*, {_ORDER} AS ab_order FROM {_PS} p))
""")
def win_rate(spark, sf):
    """A15+A16+A17: un-swap the A/B preferences by the stored order and report
    how often the first source article wins, per category."""
    p = _pair_scores(spark, sf, "fixed").withColumn("ab_order", S.ab_order("instruction_number", 42))
    for c in ("grammar", "coherence", "likability", "overall"):
        first_is_a = F.col("ab_order") == 0
        p = p.withColumn(f"{c}_winner", F.when(F.col("needs_parsing") == 1, F.lit(None))
                         .when((F.col(f"{c}_pref") == "A") == first_is_a, F.lit("first")).otherwise(F.lit("second")))
    return ST.win_rate(p)
