"""Loading the driver tables and the derived inputs every plan shares.

The reference's stage tables (model output, url-tagged corpus, usage logs)
do not exist in the test data, so they are derived from the given tables by
fixed rules that the oracle SQL repeats literally (see FIXTURES.md §2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, in its own scan splits at every size."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_with_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to a page url: page_id = doc_id % count(pages).

    The page count is a scalar subquery (one value), so the join stays an
    equi-join on both big sides; html is never read (column pruning).
    """
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    keyed = docs.withColumn("page_id", F.pmod(F.col("doc_id"), n_pages))
    return keyed.join(pages, "page_id", "inner").drop("page_id")


def numbered_lines(text_col) -> F.Column:
    """Non-blank lines of a text (blank = empty after trimming spaces)."""
    return F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")


def constraints_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for model-generated constraint lists: 'Constraints:' followed
    by the document's non-blank lines numbered '1. ', '2. ', ..."""
    docs = table(spark, sf_dir, "documents")
    items = numbered_lines(F.col("text"))
    numbered = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    body = F.array_join(numbered, "\n")
    return docs.select(
        F.col("doc_id").alias("instruction_number"),
        F.concat(F.lit("Constraints:\n"), body).alias("constraints"),
        F.col("text").alias("content"),
    )


def satisfaction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for verdict text: line i -> 'i. Yes - x' when the i-th
    non-blank line has even length, else 'i. No - x'."""
    docs = table(spark, sf_dir, "documents")
    items = numbered_lines(F.col("text"))
    verdicts = F.transform(items, lambda x, i: F.concat(
        (i + 1).cast("string"),
        F.when(F.length(x) % 2 == 0, F.lit(". Yes - x")).otherwise(F.lit(". No - x"))))
    return docs.select(
        F.col("doc_id").alias("instruction_number"),
        F.array_join(verdicts, "\n").alias("satisfaction_results"),
        F.size(items).cast("bigint").alias("subset_size"),
    )


def task_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for constraint-generation responses: a preamble, a
    'Main Task:' line (the document's first line), a 'Constraints:' marker
    and the numbered non-blank lines; every third document repeats the task
    line after the list (last one wins), every fifth has no marker at all."""
    docs = table(spark, sf_dir, "documents")
    items = numbered_lines(F.col("text"))
    first = F.coalesce(F.get(items, 0), F.lit(""))
    numbered = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nMain Task: "), F.coalesce(F.get(items, 1), F.lit("")))).otherwise(F.lit(""))
    marker = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit("Constraints:\n"))
    resp = F.concat(F.lit("Here is the analysis.\nMain Task: "), first, F.lit("\n"), marker, numbered, tail)
    return docs.select(F.col("doc_id").alias("instruction_number"), resp.alias("response"))


def _score_templates(cat, x, y):
    """The six score layouts a pairwise-evaluation response may use."""
    L = F.lit
    return [
        F.concat(L(cat + ": A "), x, L(", B "), y),
        F.concat(L(cat + " A ("), x, L(") vs B ("), y, L(")")),
        F.concat(L(cat + "\nA "), x, L("/5\nB "), y, L("/5")),
        F.concat(L(cat + ": A: "), x, L(".5 B: "), y),
        F.concat(L(cat + ":\nA - "), x, L("/5\nB - "), y, L("/5")),
        F.concat(L(cat + ": A: "), x, L("/5, B: "), y, L("/5")),
    ]


def pair_eval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for pairwise-evaluation responses: per document one of the
    six score layouts (doc_id % 7; 6 = no numbers at all), scores 1-5 from
    n_chars and doc_id."""
    d = table(spark, sf_dir, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")

    def s(v):
        return (F.pmod(v, F.lit(5)) + 1).cast("string")

    scores = {"Grammar": (s(n), s(F.floor(n / 7))), "Coherence": (s(F.floor(n / 11)), s(F.floor(n / 13))),
              "Likability": (s(i), s(F.floor(i / 3)))}
    fmt = F.pmod(i, F.lit(7))
    text = F.lit("No scores given.")
    for k in range(5, -1, -1):
        parts = [_score_templates(c, x, y)[k] for c, (x, y) in scores.items()]
        text = F.when(fmt == k, F.concat_ws("\n", *parts)).otherwise(text)
    return d.select(F.col("doc_id").alias("instruction_number"), text.alias("evaluation"))


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as model requests: key = conv_id * 100 + turn."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("key"), "conv_id", "turn", F.col("text").alias("prompt"))


def conversation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn t+1 answers the request at turn t (attempt 1, no error);
    token counts are whitespace-token counts of prompt and answer."""
    from specgrade.functions.text import word_count
    c = table(spark, sf_dir, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("answer"))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    j = u.join(a, ["conv_id", "turn"])
    key = F.col("conv_id") * 100 + F.col("turn")
    return j.select(F.concat_ws(":", F.lit("chat"), key.cast("string"), F.lit("1")).alias("request_id"),
                    key.alias("key"), F.lit(1).alias("attempt"), F.col("answer").alias("text"),
                    word_count("prompt").alias("input_tokens"), word_count("answer").alias("output_tokens"),
                    F.lit(None).cast("string").alias("error"))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response log with retries: request (conv_id, turn) made 1 + (conv_id + turn) % 3
    attempts; every attempt but the last failed, and the last failed too when
    (7 * conv_id + turn) % 5 = 0."""
    c = conversation_requests(spark, sf_dir)
    n = (1 + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))).cast("int")
    rows = c.withColumn("attempt", F.explode(F.sequence(F.lit(1), n))).withColumn("_n", n)
    last_fails = F.pmod(7 * F.col("conv_id") + F.col("turn"), F.lit(5)) == 0
    err = F.when((F.col("attempt") < F.col("_n")) | last_fails, F.lit("RateLimitError"))
    return rows.select(F.concat_ws(":", F.lit("chat"), F.col("key").cast("string"), F.col("attempt").cast("string"))
                       .alias("request_id"), "key", "attempt",
                       F.when(err.isNull(), F.col("prompt")).alias("text"),
                       F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
                       err.alias("error"))


def write_corpus_jsonl(spark: SparkSession, sf_dir: str, out_dir: str, compression: str | None = None) -> str:
    """Render the url-tagged corpus as JSON-lines dump files (the raw corpus
    format): one object per document with metadata.url; every 50th line is
    cut short, i.e. malformed.  Returns the directory written."""
    c = corpus_with_urls(spark, sf_dir)
    js = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text",
                            F.lit("2024-01-01").alias("created"), F.lit("2024-02-01").alias("added"), "source",
                            F.struct(F.col("url").alias("url")).alias("metadata")))
    line = F.when(F.col("doc_id") % 50 == 0, F.substring(js, 1, 20)).otherwise(js)
    w = c.select(line.alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(out_dir)
    return out_dir
