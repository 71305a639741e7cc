"""Stage jobs: read a stage table, run the operators, write the next table.

One function per step of the constraint study (corpus -> blog pairs ->
merged posts -> constraints -> buckets -> base -> fitted -> evaluation ->
summaries / revisions / pairwise scores).  Model steps take either a Python
``chat_fn(messages, model) -> (text, input_tokens, output_tokens)`` (run by
``infer`` on the executors) or a path to an offline response table with the
response schema.  Tables are Parquet unless the path ends in ``.csv``.

CLI: ``python -m specgrade.jobs <job> --input ... --output ... [options]``;
model steps on the CLI read ``--responses`` (an offline response table).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrade.functions import scoring as S
from specgrade.functions import text as T
from specgrade.operators import corpus as C
from specgrade.operators import features as FE
from specgrade.operators import inference as I
from specgrade.operators import lists as OL
from specgrade.operators import pairing as P
from specgrade.operators import stages as SG
from specgrade.operators import stats as ST
from specgrade.sources import corpus as SC

INT_COLUMNS = ("instruction_number", "subset_size", "blog_1_id", "blog_2_id", "text_length",
               "content_length", "fitted_length", "num_constraints", "num_satisfied", "total_constraints",
               "merged_length", "summarized_length", "original_length", "tokens_used", "attempt")

DOUBLE_COLUMNS = ("similarity", "satisfaction_rate", "compression_ratio")


# prompts whose answers are committed together
SAVE_INTERVAL = 10_000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage table; a CSV file is read with the schema of the stage columns
    its header names, all others as text."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    types = dict.fromkeys(INT_COLUMNS, "bigint") | dict.fromkeys(DOUBLE_COLUMNS, "double")
    return SC.read_stage_csv(spark, path, ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header))


def write_table(df: DataFrame, path: str) -> None:
    SC.write_stage(df, path, fmt="csv" if path.endswith(".csv") else "parquet")


def with_row_key(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Bucketed tables hold one row per (key, bucket); model calls are keyed
    per row, so add ``row_key`` = "key:subset_size" there."""
    if "subset_size" not in df.columns:
        return df, key
    return df.withColumn("row_key", F.concat_ws(":", F.col(key).cast("string"), F.col("subset_size").cast("string"))), "row_key"


def _side_path(output_path: str, name: str) -> str:
    return output_path.rstrip("/").removesuffix(".csv") + "." + name


def _responses(spark, requests: DataFrame, output_path: str, chat_fn=None, responses_path: str | None = None,
               max_attempts: int = 3, save_interval: int = SAVE_INTERVAL, accept=None) -> DataFrame:
    """The stored answers to ``requests``.  Without an offline table the
    requests are stored beside the output, and every distinct prompt is asked
    until an answer is accepted, batch by batch; each batch's answers are
    committed to a ledger beside the output before the next is asked.  A rerun
    asks only what the ledger does not answer yet."""
    if responses_path:
        return read_table(spark, responses_path)
    if chat_fn is None:
        raise ValueError("a model step needs chat_fn or an offline responses table")
    asked_at = _side_path(output_path, "requests")
    requests.write.mode("overwrite").parquet(asked_at)
    asked = spark.read.parquet(asked_at)
    return I.to_keys(asked, I.answer_in_batches(asked, chat_fn, _side_path(output_path, "responses"), save_interval, max_attempts, accept))


def parse_blogs(spark, input_path: str, output_path: str, min_len: int = 1000, max_len: int = 2000,
                glob: str = "*.jsonl") -> DataFrame:
    """Corpus dumps (JSON lines, optionally compressed) -> raw_blogs; returns
    the per-file / total counts of all lines, malformed ones too, and of kept
    ones.

    The dumps are parsed once, into a table beside the output with one row a
    line by ``kind``: a kept line's columns, a malformed line's text, of other
    lines the file alone.  The output and the counts are read from it."""
    every = SC.read_corpus_lines(spark, input_path, glob).withColumns({"url": F.col("metadata.url"), "line": F.col("_corrupt_record")})
    bad = F.col("line").isNotNull()
    every = every.withColumn("kind", F.when(bad, "bad").when(C.corpus_kept(min_len, max_len), "kept").otherwise("dropped"))
    norm = T.normalize_text("text")
    values = {c: F.col(c) for c in ("id", "url", "created", "added", "source")} | {"text": norm, "text_length": T.char_length(norm)}
    lines = every.select("kind", "file", "line", *[F.when(F.col("kind") == "kept", values[c]).alias(c) for c in C.RAW_BLOG_COLUMNS])
    at = _side_path(output_path, "lines")
    lines.write.mode("overwrite").partitionBy("kind").parquet(at)
    held = spark.read.schema(lines.schema).parquet(at)
    write_table(held.filter("kind = 'kept'").select(*C.RAW_BLOG_COLUMNS), output_path)
    return C.ingest_stats(held.select("file", "kind"), "file", F.col("kind") == "kept")


def find_blog_pairs(spark, input_path: str, output_path: str, max_size: int | None = None, max_pairs: int = 25,
                    lo: float = 0.40, hi: float = 0.50, min_words: int | None = None,
                    max_words: int | None = None, distinct: bool = True, seed: int = 0, dim: int = 256) -> DataFrame:
    """raw_blogs -> pairs (blog_1_id, blog_2_id, texts, similarity): word
    filter, all texts (or the first ``max_size`` by id), positional ids, embeddings,
    sampled candidates, band, (distinct) pairs."""
    blogs = C.filter_word_band(read_table(spark, input_path).select("id", "text"), min_words, max_words)
    first = blogs if max_size is None else C.take_first(blogs, max_size, ["id"])
    numbered = C.assign_row_number(first, ["id"], out="vec_id", start=0)
    emb = FE.embed_text(numbered, "text", dim)
    find = P.find_pairs_distinct if distinct else P.find_pairs
    pairs = find(emb, lo, hi, max_pairs, seed=seed)
    out = P.attach_pair_text(pairs, numbered.select("vec_id", "text"), "vec_id", max_pairs=max_pairs)
    write_table(out, output_path)
    return P.pair_stats(pairs)


def merge_blogs(spark, input_path: str, output_path: str, chat_fn=None, responses_path=None,
                model: str = "default") -> DataFrame:
    pairs = read_table(spark, input_path).withColumn(
        "pair_id", F.concat_ws("-", F.col("blog_1_id").cast("string"), F.col("blog_2_id").cast("string")))
    reqs = SG.merge_requests(pairs, "pair_id", model)
    merged = SG.merge_results(pairs, _responses(spark, reqs, output_path, chat_fn, responses_path), "pair_id", model)
    write_table(merged, output_path)
    return ST.merge_summary(read_table(spark, output_path))


def generate_constraints(spark, input_path: str, output_path: str, content_col: str = "merged_blog",
                         key: str = "instruction_number", chat_fn=None, responses_path=None,
                         model: str = "default", lenient: bool = False) -> DataFrame:
    df = read_table(spark, input_path)
    if key not in df.columns:
        df = C.assign_row_number(df, ["pair_id"] if "pair_id" in df.columns else [content_col], out=key)
    reqs = SG.constraints_requests(df, key, content_col, model)
    out = SG.constraints_results(df, _responses(spark, reqs, output_path, chat_fn, responses_path), key, model, lenient,
                                 content_col)
    write_table(out, output_path)
    return read_table(spark, output_path).agg(F.count_if(F.col("empty_parse").cast("boolean")).alias("empty_parses"), F.count(F.lit(1)).alias("rows"))


def expand_constraint_buckets(spark, input_path: str, output_path: str, sizes="7,15,23,31,39",
                              constraint_col: str = "constraints") -> DataFrame:
    df = read_table(spark, input_path)
    out = OL.expand_buckets(df, constraint_col, sizes)
    write_table(out, output_path)
    return OL.bucket_counts(out, OL.parse_sizes(sizes) if isinstance(sizes, str) else sizes)


def generate_base(spark, input_path: str, output_path: str, key: str = "instruction_number",
                  task_col: str = "main_task", chat_fn=None, responses_path=None, model: str = "default") -> None:
    df = read_table(spark, input_path)
    # a bucketed table has several rows per key, in the order of its buckets
    reqs = SG.base_requests(df, key, task_col, dedupe="subset_size" in df.columns, model=model)
    write_table(SG.base_results(df, _responses(spark, reqs, output_path, chat_fn, responses_path), key, model), output_path)


def _constraints_col(df: DataFrame, given: str | None) -> str:
    """Bucketed tables carry the bucket's list in ``selected_constraints``."""
    return given or ("selected_constraints" if "selected_constraints" in df.columns else "constraints")


def fit_constraints(spark, constraints_path: str, base_path: str, output_path: str,
                    key: str = "instruction_number", constraint_col: str | None = None,
                    base_col: str = "base_content", chat_fn=None, responses_path=None,
                    model: str = "default") -> None:
    cons, base = read_table(spark, constraints_path), read_table(spark, base_path)
    constraint_col = _constraints_col(cons, constraint_col)
    cons, rk = with_row_key(cons, key)
    rk = None if rk == key else rk
    reqs = SG.fit_requests(cons, base, key, constraint_col, base_col, model, response_key=rk)
    resp = _responses(spark, reqs, output_path, chat_fn, responses_path)
    write_table(SG.fit_results(cons, base, resp, key, constraint_col, base_col, model, response_key=rk), output_path)


def evaluate(spark, input_path: str, output_path: str, key: str = "instruction_number",
             content_col: str = "fitted_content", constraints_col: str | None = None, chat_fn=None,
             responses_path=None, model: str = "default") -> DataFrame:
    df, rk = with_row_key(read_table(spark, input_path), key)
    constraints_col = _constraints_col(df, constraints_col)
    reqs = SG.evaluate_requests(df, rk, content_col, constraints_col, model)
    out = SG.evaluate_results(df, _responses(spark, reqs, output_path, chat_fn, responses_path), rk, constraints_col, model)
    write_table(out, output_path)
    return ST.describe_rate(read_table(spark, output_path))


def summarize(spark, input_path: str, output_path: str, key: str = "instruction_number",
              content_col: str = "fitted_content", target_pct: float = 0.25, chat_fn=None,
              responses_path=None, model: str = "default") -> DataFrame:
    df, rk = with_row_key(read_table(spark, input_path), key)
    reqs = SG.summarize_requests(df, rk, content_col, target_pct, model)
    out = SG.summarize_results(df, _responses(spark, reqs, output_path, chat_fn, responses_path), rk, content_col, model)
    write_table(out, output_path)
    return ST.compression_summary(read_table(spark, output_path), target_pct)


def fit_direct(spark, constraints_path: str, merged_path: str, output_path: str, key: str = "instruction_number",
               content_col: str = "merged_blog", constraint_col: str = "constraints", chat_fn=None, responses_path=None,
               model: str = "default") -> None:
    """Constraints fitted onto the merged texts themselves."""
    cons, merged = read_table(spark, constraints_path), read_table(spark, merged_path)
    orders = {"constraints_order": cons.columns[:1], "merged_order": merged.columns[:1]}
    pairs = SG.fit_direct_pairs(cons, merged, key, content_col, **orders)
    reqs = SG.fit_direct_requests(pairs, key if key in merged.columns and key in cons.columns else "position", content_col, constraint_col, model)
    resp = _responses(spark, reqs, output_path, chat_fn, responses_path)
    write_table(SG.fit_direct_results(cons, merged, resp, key, content_col, constraint_col, model, **orders), output_path)


def revise(spark, input_path: str, output_path: str, key: str = "instruction_number", base_col: str = "base_content",
           constraints_col: str = "constraints", n: int = 23, chat_fn=None, responses_path=None, model: str = "default") -> None:
    """Texts rewritten until their first ``n`` constraints hold."""
    df = read_table(spark, input_path)
    reqs = SG.revise_requests(df, key, base_col, constraints_col, n, model)
    write_table(SG.revise_results(df, _responses(spark, reqs, output_path, chat_fn, responses_path), key, base_col, model), output_path)


def pairwise(spark, input_path: str, other_path: str, output_path: str, col_a: str = "base_content", col_b: str = "fitted_content",
             key: str = "instruction_number", seed: int = 42, chat_fn=None, responses_path=None, model: str = "default") -> DataFrame:
    """Two tables' texts judged row by row in a seeded order, asked again while
    the scores do not parse (B15); returns pairs and unparsed ones."""
    reqs = SG.pairwise_requests(read_table(spark, input_path), read_table(spark, other_path), [key], [key], col_a, col_b, seed, model)
    resp = _responses(spark, reqs, output_path, chat_fn, responses_path, accept=S.has_pair_scores)
    pairs = reqs.select(F.col("key").alias("position"), S.ab_order("key", seed).alias("order"))
    write_table(SG.pairwise_results(pairs, resp, "position", model=model), output_path)
    return read_table(spark, output_path).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("needs_parsing").cast("bigint")).alias("n_unparsed"))


JOBS = {"parse_blogs": parse_blogs, "find_blog_pairs": find_blog_pairs, "merge_blogs": merge_blogs,
        "generate_constraints": generate_constraints, "expand_constraint_buckets": expand_constraint_buckets,
        "generate_base": generate_base, "fit_constraints": fit_constraints, "fit_direct": fit_direct, "evaluate": evaluate,
        "summarize": summarize, "revise": revise, "pairwise": pairwise}


def main(argv=None):
    ap = argparse.ArgumentParser(prog="specgrade.jobs")
    ap.add_argument("job", choices=sorted(JOBS))
    ap.add_argument("--input", required=True, help="input table (or corpus dir for parse_blogs)")
    ap.add_argument("--output", required=True)
    ap.add_argument("--base", help="the second table: base (fit_constraints), merged (fit_direct), the other texts (pairwise)")
    ap.add_argument("--responses", help="offline response table for model steps")
    ap.add_argument("--min-len", type=int, default=1000)
    ap.add_argument("--max-len", type=int, default=2000)
    ap.add_argument("--max-size", type=int, default=None)
    ap.add_argument("--max-pairs", type=int, default=25)
    ap.add_argument("--band", type=float, nargs=2, default=(0.40, 0.50))
    ap.add_argument("--sizes", default="7,15,23,31,39")
    ap.add_argument("--model", default="default")
    ap.add_argument("--glob", default="*.jsonl", help="corpus file pattern (parse_blogs)")
    a = ap.parse_args(argv)
    from specgrade.session import get_spark
    spark = get_spark()
    if a.job == "parse_blogs":
        res = parse_blogs(spark, a.input, a.output, a.min_len, a.max_len, a.glob)
    elif a.job == "find_blog_pairs":
        res = find_blog_pairs(spark, a.input, a.output, a.max_size, a.max_pairs, *a.band)
    elif a.job == "expand_constraint_buckets":
        res = expand_constraint_buckets(spark, a.input, a.output, a.sizes)
    elif a.job in ("fit_constraints", "fit_direct", "pairwise"):
        res = JOBS[a.job](spark, a.input, a.base, a.output, responses_path=a.responses, model=a.model)
    else:
        res = JOBS[a.job](spark, a.input, a.output, responses_path=a.responses, model=a.model)
    if res is not None:
        res.show(truncate=False)


if __name__ == "__main__":
    main()
