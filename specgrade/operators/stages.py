"""Model stages as request/response compositions.

Each stage has a ``*_requests`` builder (job 1) and a ``*_results`` function
that attaches a response table and parses it (job 2).  Templates are short
and our own; only placeholders and the output contract matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.functions import lists as L
from specgrade.functions import scoring as S
from specgrade.functions.text import char_length, py_strip
from specgrade.operators import inference as I
from specgrade.operators import joins as J

TEMPLATES = {
    "merge": "Combine the two blog posts into one coherent post.\n\nPost 1:\n{blog_1}\n\nPost 2:\n{blog_2}",
    "constraints": "Read the text and state its main task and 39 atomic constraints.\n"
                   "Answer as 'Main Task: ...' then 'Constraints:' and a numbered list.\n\n{content}",
    "common_constraints": "State the shared main task and constraints of both texts.\n\nText 1:\n{blog_1}\n\nText 2:\n{blog_2}",
    "base": "Write a blog post of about 400 words for this task:\n{main_task}",
    "fit": "Task: {main_task}\n\nRevise the draft so it satisfies every constraint.\n\nConstraints:\n{constraints}\n\nDraft:\n{base}",
    "fit_direct": "Rewrite the text so that every constraint below holds.\n\nConstraints:\n{constraints}\n\nText:\n{content}",
    "summarize": "Summarize the text to about {pct}% of its length.\n\n{content}",
    "evaluate": "For each constraint answer 'n. Yes - reason' or 'n. No - reason'.\n\n"
                "Constraints:\n{constraints}\n\nText:\n{content}",
    "replace": "Main Task: {main_task}\nReplace every satisfied constraint with a new one and keep the others.\n\n"
               "Constraints:\n{constraints}\n\nVerdicts:\n{results}",
    "revise": "Rewrite this text until all {n} requirements hold.\n\nText:\n{content}\n\nRequirements:\n{constraints}",
    "pairwise": "First text (A)\n{story_a}\n\nSecond text (B)\n{story_b}",
    "legacy_eval": "Story:\n{story}\n\nThere are {count} constraints:\n{constraints}",
}
PAIRWISE_SYSTEM = ("Compare stories A and B on Grammar, Coherence and Likability; rate each out of 5 "
                   "and name the preferred story per category and overall.")

# ---- fixed values (must equal the reference for identical results) ----------
LEGACY_NAMES = {
    "instruction_number": "Instruction Number", "instruction": "Instruction", "constraints": "Constraints", "main_task": "Main Task",
    "original_blog_1": "Original Blog 1", "original_blog_2": "Original Blog 2", "merged_blog": "Merged Blog", "similarity": "Similarity",
    "base_content": "base_blog", "fitted_content": "fitted_blog", "summarized_content": "fitted_summarized_blog",
    "selected_constraints": "SelectedConstraints", "subset_size": "Number_of_Constraints",
}
EVALUATION_NAMES = {
    "fitted_summarized_blog": "FinalGeneratedStory",
    "selected_constraints": "SelectedConstraints",
    "subset_size": "Number_of_Constraints",
}
# ------------------------------------------------------------------------------


def to_evaluation_names(df: DataFrame) -> DataFrame:
    """the summarised table under the names that the evaluation reads
    (``legacy_eval_requests``); a table with ``summarized_content`` first gets
    the notebook name."""
    if "fitted_summarized_blog" not in df.columns:
        df = df.withColumnsRenamed({"summarized_content": "fitted_summarized_blog"})
    return df.withColumnsRenamed(EVALUATION_NAMES)


def to_legacy_names(df: DataFrame) -> DataFrame:
    """The notebook column names for the same stage tables."""
    return df.withColumnsRenamed({k: v for k, v in LEGACY_NAMES.items() if k in df.columns})


# B5 ----------------------------------------------------------------------
def merge_requests(pairs: DataFrame, key: str = "pair_id", model: str = "default") -> DataFrame:
    return I.build_requests(pairs, "merge", key, TEMPLATES["merge"],
                            {"blog_1": "blog_1_text", "blog_2": "blog_2_text"}, model=model)


def merge_results(pairs: DataFrame, responses: DataFrame, key: str = "pair_id", model: str = "default",
                  band: tuple[float, float] = (0.40, 0.50)) -> DataFrame:
    r = I.attach_responses(pairs, responses, key, "merged_blog", F.lit(""))
    return I.stamp_output(r.select(
        key, F.col("blog_1_text").cast("string").alias("original_blog_1"),
        F.col("blog_2_text").cast("string").alias("original_blog_2"), "merged_blog", "similarity",
        F.when(F.col("similarity").between(*band), F.lit("dissimilar")).otherwise(F.lit("similar")).alias("merge_type"),
        "blog_1_id", "blog_2_id", char_length(F.coalesce("merged_blog", F.lit(""))).alias("merged_length"),
        "tokens_used", "error"), model)


# B6 / B7 -----------------------------------------------------------------
def constraints_requests(df: DataFrame, key: str = "instruction_number", content: str = "merged_blog",
                         model: str = "default") -> DataFrame:
    return I.build_requests(df, "constraints", key, TEMPLATES["constraints"], {"content": content}, model=model)


def constraints_results(df: DataFrame, responses: DataFrame, key: str = "instruction_number",
                        model: str = "default", lenient: bool = False, content: str = "merged_blog") -> DataFrame:
    """``instruction`` is the content the constraints were drawn from.
    B7 tables (``lenient``) also carry the two source texts, as blog1 and blog2."""
    r = I.attach_responses(df, responses, key, "_resp", F.lit(None).cast("string"))
    parsed = L.with_task_split(r, "_resp", "_p", lenient=lenient)
    parsed = parsed.withColumn("_p", F.when(F.col("_resp").isNotNull(), F.col("_p")))
    sources = [F.col(f"blog_{i}_text").alias(f"blog{i}") for i in (1, 2) if f"blog_{i}_text" in df.columns]
    instruction = F.col(content) if content in df.columns else F.lit(None).cast("string")
    out = parsed.select(key, instruction.alias("instruction"), *sources,
                        F.coalesce(F.col("_p.main_task"), F.lit("")).alias("main_task"),
                        F.coalesce(F.col("_p.constraints"), F.lit("")).alias("constraints"),
                        "tokens_used", "error")
    out = out.withColumn("empty_parse", L.empty_parse_flag("constraints"))
    return I.stamp_output(out, model)


def common_constraints_requests(pairs: DataFrame, key: str, col1: str = "blog_1_text", col2: str = "blog_2_text",
                                model: str = "default") -> DataFrame:
    return I.build_requests(pairs, "common_constraints", key, TEMPLATES["common_constraints"],
                            {"blog_1": col1, "blog_2": col2}, model=model)


# B8 ----------------------------------------------------------------------
def base_requests(df: DataFrame, key: str = "instruction_number", task_col: str = "main_task",
                  dedupe: bool = True, model: str = "default", order: str | list[str] | None = None) -> DataFrame:
    """``dedupe``: one request per key, of its first row by ``order`` (the
    buckets' order where the table has them)."""
    order = J.default_order(df, order)
    names = list(dict.fromkeys([key, task_col, *([order] if isinstance(order, str) else order or [])]))
    src = J.dedupe_first(df.select(*names), key, order) if dedupe else df
    return I.build_requests(src, "base", key, TEMPLATES["base"], {"main_task": task_col}, model=model)


def base_results(df: DataFrame, responses: DataFrame, key: str = "instruction_number",
                 model: str = "default") -> DataFrame:
    """Generate once per key, replicate to every row of ``df``."""
    once = df.select(key).distinct()
    gen = I.attach_responses(once, responses, key, "base_content", F.lit(""))
    gen = gen.withColumn("content_length", char_length("base_content"))
    return I.stamp_output(J.replicate_left(df, gen, key, ["base_content", "content_length", "tokens_used", "error"]),
                          model)


# B9 / B10 ----------------------------------------------------------------
def fit_requests(constraints: DataFrame, base: DataFrame, key: str = "instruction_number",
                 constraint_col: str = "constraints", base_col: str = "base_content",
                 model: str = "default", dedupe_right: bool = True, response_key: str | None = None,
                 order: str | list[str] | None = None) -> DataFrame:
    """B9 requests; of several base rows of a key the first by ``order`` counts; ``response_key`` keys one request per constraint row when
    that side has several rows per key (buckets)."""
    j = J.join_constraints_base(constraints, base, key, dedupe_right, order)
    j = j.withColumns({"_task": J.resolve_column(j, "main_task"), "_cons": J.resolve_column(j, constraint_col, default="constraints"),
                       "_base": J.resolve_column(j, base_col, default="base_content")})
    return I.build_requests(j, "fit", response_key or key, TEMPLATES["fit"],
                            {"main_task": "_task", "constraints": "_cons", "base": "_base"}, model=model)


def fit_results(constraints: DataFrame, base: DataFrame, responses: DataFrame, key: str = "instruction_number",
                constraint_col: str = "constraints", base_col: str = "base_content", model: str = "default",
                dedupe_right: bool = True, response_key: str | None = None, order: str | list[str] | None = None) -> DataFrame:
    """B9; a failed row has an empty text and 0 constraints.  ``response_key`` names a per-row request key when the constraint
    side has several rows per key (buckets)."""
    j = J.join_constraints_base(constraints, base, key, dedupe_right, order)
    j = j.withColumns({"main_task": J.resolve_column(j, "main_task"),
                       "_cons": J.resolve_column(j, constraint_col, default="constraints"),
                       "_base": J.resolve_column(j, base_col, default="base_content")})
    rk = response_key or key
    r = I.attach_responses(j, responses, rk, "fitted_content", F.lit(""))
    out = r.select(key, *([rk] if rk != key else []), "main_task", F.col("_cons").alias("constraints"), F.col("_base").alias("base_content"),
                   "fitted_content", char_length("fitted_content").alias("fitted_length"),
                   F.when(F.col("error").isNull(), L.count_numbered("_cons").cast("int")).otherwise(0).alias("num_constraints"),
                   *_subset_size(j), "tokens_used", "error")
    return I.stamp_output(out, model)


def _subset_size(j: DataFrame) -> list:
    """The constraint side's bucket size, whatever suffix the join gave it."""
    for c in ("subset_size", "subset_size_constraint"):
        if c in j.columns:
            return [F.col(c).alias("subset_size")]
    return []


def fit_direct_pairs(constraints: DataFrame, merged: DataFrame, key: str = "instruction_number", content_col: str = "merged_blog",
                     constraints_order: list[str] | None = None, merged_order: list[str] | None = None) -> DataFrame:
    """B10's rows: constraints and merged texts joined by ``key`` where both
    tables have it, else row by row in the stated orders, truncated to the
    shorter table; then ``position`` numbers the pairs."""
    if key in constraints.columns and key in merged.columns:
        return J.join_pruned(constraints, merged, key, [content_col])
    if not constraints_order or not merged_order:
        raise ValueError(f"without {key} on both sides rows are paired by position: state both orders")
    order = {c: f"_sg_order_{i}" for i, c in enumerate(merged_order)}
    side = merged.select(*[F.col(c).alias(n) for c, n in order.items()], F.col(content_col).alias("_sg_content"))
    rows = J.zip_join(constraints.drop(content_col), side, constraints_order, list(order.values()))
    return rows.drop(*order.values()).withColumnRenamed("_sg_content", content_col)


def fit_direct_requests(pairs: DataFrame, key: str = "instruction_number", content_col: str = "merged_blog",
                        constraint_col: str = "constraints", model: str = "default") -> DataFrame:
    """B10 requests for the rows of ``fit_direct_pairs``."""
    return I.build_requests(pairs, "fit_direct", key, TEMPLATES["fit_direct"], {"constraints": constraint_col, "content": content_col}, model=model)


def fit_direct_results(constraints: DataFrame, merged: DataFrame, responses: DataFrame, key: str,
                       content_col: str = "merged_blog", constraint_col: str = "constraints",
                       model: str = "default", constraints_order: list[str] | None = None, merged_order: list[str] | None = None) -> DataFrame:
    """Fit onto the merged text; a failure keeps the original as the
    fitted text with ``error`` set and counters null (Q18).  Rows paired by
    position answer to the key ``position``."""
    j = fit_direct_pairs(constraints, merged, key, content_col, constraints_order, merged_order)
    key = key if key in merged.columns and key in constraints.columns else "position"
    r = I.attach_responses(j, responses, key, "_fit", F.lit(None).cast("string"))
    ok = F.col("_fit").isNotNull()
    return I.stamp_output(r.select(
        "*", F.col(content_col).alias("merged_blog_original"),
        F.coalesce("_fit", content_col).alias("fitted_content"),
        F.when(ok, char_length("_fit")).alias("fitted_length"),
        F.when(ok, char_length(content_col)).alias("original_length"),
        F.when(ok, L.count_digit_lines(constraint_col)).alias("num_constraints")).drop("_fit"), model)


# B11 ---------------------------------------------------------------------
def revise_results(df: DataFrame, responses: DataFrame, key: str, base_col: str, model: str = "default") -> DataFrame:
    """Revised text; rows with an empty base were never requested and
    keep an empty output without an error."""
    r = I.attach_responses(df, responses, key, "revised_content", F.lit(""))
    empty = py_strip(F.coalesce(F.col(base_col), F.lit(""))) == ""
    return I.stamp_output(r.withColumn("error", F.when(empty, F.lit(None)).otherwise(F.col("error"))), model)


def revise_requests(df: DataFrame, key: str, base_col: str, cons_col: str, n: int = 23,
                    model: str = "default") -> DataFrame:
    """Rows with a blank base get no request (their output is empty).  The
    prompt names as many constraints as it lists, ``n`` at most."""
    src = df.filter(py_strip(F.coalesce(F.col(base_col), F.lit(""))) != "").withColumn(
        "_items", L.parse_numbered_inline(cons_col))
    src = src.withColumns({"_top": L.take_constraints("_items", n),
                           "_n": F.coalesce(F.least(F.size("_items"), F.lit(n)), F.lit(0)).cast("string")})
    return I.build_requests(src, "revise", key, TEMPLATES["revise"],
                            {"content": base_col, "constraints": "_top", "n": "_n"}, model=model)


# B12 ---------------------------------------------------------------------
def summarize_requests(df: DataFrame, key: str, content_col: str = "fitted_content", target_pct: float = 0.25,
                       model: str = "default") -> DataFrame:
    pct = str(int(target_pct * 100))
    return I.build_requests(df.withColumn("_pct", F.lit(pct)), "summarize", key, TEMPLATES["summarize"],
                            {"content": content_col, "pct": "_pct"}, model=model)


def summarize_results(df: DataFrame, responses: DataFrame, key: str, content_col: str = "fitted_content",
                      model: str = "default") -> DataFrame:
    r = I.attach_responses(df, responses, key, "_sum", F.lit(None).cast("string"))
    failed = F.col("_sum").isNull()
    orig = F.coalesce(F.col(content_col), F.lit(""))
    summary = F.coalesce(F.col("_sum"), orig)
    out = r.withColumns({"summarized_content": summary, "summarized_length": char_length(summary),
                         "original_length": char_length(orig)})
    out = out.withColumn("compression_ratio",
                         S.compression_ratio("summarized_length", "original_length", failed)).drop("_sum")
    return I.stamp_output(out, model)


# B13 ---------------------------------------------------------------------
def evaluate_requests(df: DataFrame, key: str, content_col: str = "fitted_content",
                      constraints_col: str = "constraints", model: str = "default") -> DataFrame:
    return I.build_requests(df, "evaluate", key, TEMPLATES["evaluate"],
                            {"content": content_col, "constraints": constraints_col}, model=model)


def evaluate_results(df: DataFrame, responses: DataFrame, key: str, constraints_col: str = "constraints",
                     model: str = "default") -> DataFrame:
    """Verdict text -> num_satisfied (A1), total (A3), rate (A4); a failed row
    keeps the total, has 0 satisfied, an empty verdict text, a null rate and
    the error text (Q4)."""
    r = I.attach_responses(df, responses, key, "satisfaction_results", F.lit(""))
    total = (F.col("subset_size").cast("bigint") if "subset_size" in df.columns
             else L.count_numbered(constraints_col))
    out = r.withColumns({"num_satisfied": F.when(F.col("error").isNull(), S.count_yes("satisfaction_results")).otherwise(0),
                         "total_constraints": total})
    out = out.withColumn("satisfaction_rate", F.when(F.col("error").isNull(),
                                                     S.satisfaction_rate("num_satisfied", "total_constraints")))
    return I.stamp_output(out, model)


# B14 / B16 ---------------------------------------------------------------
def replace_requests(constraints: DataFrame, base: DataFrame, evaluation: DataFrame,
                     key: str = "instruction_number", model: str = "default") -> DataFrame:
    j = J.join_three(constraints, base, evaluation, key)
    j = j.withColumns({"_task": J.resolve_column(j, "main_task"),
                       "_cons": J.resolve_column(j, "constraints"),
                       "_res": J.resolve_column(j, "satisfaction_results", ("", "_eval"))})
    return I.build_requests(j, "replace", key, TEMPLATES["replace"],
                            {"main_task": "_task", "constraints": "_cons", "results": "_res"}, model=model)


def replace_results(df: DataFrame, responses: DataFrame, key: str = "instruction_number",
                    model: str = "default") -> DataFrame:
    """The revised task and list beside the original list and the base
    (where ``df`` has them); a failed row keeps its task and gets an empty
    list."""
    r = I.attach_responses(df, responses, key, "_resp", F.lit(None).cast("string"))
    p = L.with_task_split(r, "_resp", "_p", markers=("Constraints:", "Revised Constraints:"))
    revised_task = F.coalesce(F.col("_p.main_task"), F.lit(""))
    task = F.when(F.col("error").isNull(), revised_task)
    if "main_task" in df.columns:
        task = task.otherwise(F.col("main_task"))
    out = p.withColumns({"main_task": task, "revised_constraints": F.when(
        F.col("error").isNull(), F.coalesce(F.col("_p.constraints"), F.lit(""))).otherwise("")})
    if "constraints" in df.columns:
        out = out.withColumnRenamed("constraints", "original_constraints")
    return I.stamp_output(out.drop("_resp", "_p"), model)


def check_replacement(original: DataFrame, revised: DataFrame, verdicts: DataFrame,
                      key: str = "instruction_number") -> DataFrame:
    """Per key, 'No' constraints kept verbatim, 'Yes' constraints gone,
    and the total unchanged — as joins on (key, constraint text) rows."""
    orig = original.select(key, "idx", F.trim("constraint").alias("c"))
    rev = revised.select(key, F.trim("constraint").alias("c")).distinct()
    v = verdicts.select(key, "idx", "verdict")
    ov = orig.join(v, [key, "idx"], "left")
    kept = ov.join(rev.withColumn("_in", F.lit(True)), [key, "c"], "left")
    per = kept.groupBy(key).agg(
        F.count_if((F.col("verdict") == "No") & F.col("_in").isNull()).alias("no_missing"),
        F.count_if((F.col("verdict") == "Yes") & F.col("_in").isNotNull()).alias("yes_remaining"),
        F.count(F.lit(1)).alias("n_original"))
    n_rev = revised.groupBy(key).agg(F.count(F.lit(1)).alias("n_revised"))
    return per.join(n_rev, key, "left").withColumn(
        "ok", (F.col("no_missing") == 0) & (F.col("yes_remaining") == 0)
        & (F.coalesce(F.col("n_revised"), F.lit(0)) == F.col("n_original")))


# B15 ---------------------------------------------------------------------
def pairwise_requests(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str],
                      col_a: str, col_b: str, seed: int = 42, model: str = "default") -> DataFrame:
    """A/B prompts in a seeded order per position (A15); order stored."""
    z = J.zip_join(left.select(*left_order, F.col(col_a).alias("_a")),
                   right.select(*right_order, F.col(col_b).alias("_b")), left_order, right_order, warn=False)
    z = z.withColumn("order", S.ab_order("position", seed))
    z = z.withColumns({"_sa": F.when(F.col("order") == 1, F.col("_b")).otherwise(F.col("_a")),
                       "_sb": F.when(F.col("order") == 1, F.col("_a")).otherwise(F.col("_b"))})
    return I.build_requests(z, "pairwise", "position", TEMPLATES["pairwise"], {"story_a": "_sa", "story_b": "_sb"},
                            system_template=PAIRWISE_SYSTEM, model=model)


def pairwise_results(pairs: DataFrame, responses: DataFrame, key: str = "position", mode: str = "fixed",
                     model: str = "default") -> DataFrame:
    """The accepted answer is the one whose scores parse (A18: a pair is
    flagged only when none of its attempts does; its last answer is kept)."""
    r = I.attach_responses(pairs, responses, key, "evaluations_raw", F.lit(None).cast("string"), accept=S.has_pair_scores)
    cols = [f"{c}_score_{x}" for c in ("grammar", "coherence", "likability") for x in "AB"]
    cols += [f"{c}_pref" for c in ("grammar", "coherence", "likability", "overall")]
    out = S.with_pair_scores(r, "evaluations_raw", mode, "_p").select("*", *[F.col("_p." + c).alias(c) for c in cols],
                                       F.when(F.col("_p").isNull(), 1).otherwise(0).alias("needs_parsing")).drop("_p")
    return I.stamp_output(out.withColumnRenamed("tokens_used", "evaluation_tokens"), model)


# B17 ---------------------------------------------------------------------
def legacy_eval_requests(df: DataFrame, key: str, story: str = "FinalGeneratedStory",
                         constraints: str = "SelectedConstraints", count: str = "Number_of_Constraints",
                         model: str = "default") -> DataFrame:
    return I.build_requests(df, "legacy_eval", key, TEMPLATES["legacy_eval"],
                            {"story": story, "constraints": constraints, "count": count}, model=model)
