"""Batch-inference bookkeeping.

A model stage is two Spark jobs with tables in between:
``build_requests`` -> request table -> (``infer`` with a user function, or an
offline response file) -> response table -> ``attach_responses`` + parsing.
Model calls never hide inside Column expressions, so retries, cost and
determinism stay visible in tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrade.sources.ledger import BatchLedger, fingerprint

REQUEST_SCHEMA = ("request_id string, stage string, key bigint, attempt int, model string, "
                  "messages array<struct<role:string,content:string>>, prompt_hash string")
RESPONSE_SCHEMA = ("request_id string, key bigint, attempt int, text string, input_tokens bigint, "
                   "output_tokens bigint, error string")


def render(template: str, values: dict[str, Column]) -> Column:
    """Literal placeholder replacement ``{name}`` -> column value (never a
    format function: bodies may contain braces or %)."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def build_requests(df: DataFrame, stage: str, key: str, user_template: str, values: dict[str, str],
                   system_template: str | None = None, model: str = "default", attempt: int = 1) -> DataFrame:
    """B1: one request row per input row; ``prompt_hash`` = sha256 of model,
    system and user text (used to dedupe identical calls)."""
    cols = {k: F.col(v) for k, v in values.items()}
    user = render(user_template, cols)
    msgs = [F.struct(F.lit("user").alias("role"), user.alias("content"))]
    sys_text = F.lit("")
    if system_template is not None:
        sys_text = render(system_template, cols)
        msgs.insert(0, F.struct(F.lit("system").alias("role"), sys_text.alias("content")))
    rid = F.concat_ws(":", F.lit(stage), F.col(key).cast("string"), F.lit(str(attempt)))
    return df.select(rid.alias("request_id"), F.lit(stage).alias("stage"), F.col(key).alias("key"),
                     F.lit(attempt).alias("attempt"), F.lit(model).alias("model"), F.array(*msgs).alias("messages"),
                     F.sha2(F.concat_ws("\u0001", F.lit(model), sys_text, user), 256).alias("prompt_hash"))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """B2: one request per distinct prompt (smallest key wins).  The aggregate
    holds (prompt hash, key); the messages are fetched late, spread by both,
    so one very common prompt is one row per task before the shuffle and no
    group after it."""
    first = requests.groupBy("prompt_hash").agg(F.min("key").alias("key"))
    w = Window.partitionBy("prompt_hash", "key").orderBy("attempt", "request_id")
    return (requests.join(first, ["prompt_hash", "key"], "left_semi").withColumn("_nth", F.row_number().over(w))
            .filter("_nth = 1").select(*[c for c in requests.columns if c != "prompt_hash"], "prompt_hash"))


def infer(requests: DataFrame, chat_fn: Callable, max_attempts: int = 3, retry_delay: float = 0.0) -> DataFrame:
    """Call ``chat_fn(messages, model) -> (text, input_tokens, output_tokens)``
    for every request inside ``mapInPandas`` (one client per task, in-task
    retries, errors captured in the ``error`` column and never raised).
    Throughput scales with the number of partitions of ``requests``."""
    schema = RESPONSE_SCHEMA.replace("key bigint", f"key {requests.schema['key'].dataType.simpleString()}")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                msgs = [dict(m) if not isinstance(m, dict) else m for m in r.messages]
                text, itok, otok, err = None, 0, 0, None
                for a in range(max_attempts):
                    try:
                        text, itok, otok = chat_fn(msgs, r.model)
                        err = None
                        break
                    except Exception as e:  # captured, the row is never lost
                        err = f"{type(e).__name__}: {e}"
                        if retry_delay:
                            time.sleep(retry_delay)
                out.append((r.request_id, r.key, r.attempt, text, int(itok or 0), int(otok or 0), err))
            yield pd.DataFrame(out, columns=["request_id", "key", "attempt", "text", "input_tokens",
                                             "output_tokens", "error"])
    return requests.select("request_id", "key", "attempt", "model", "messages").mapInPandas(run, schema)


def normalize_usage(responses: DataFrame, total_col: str | None = None) -> DataFrame:
    """Provider usage in either form -> input/output token columns; a
    single ``total`` field counts as input; missing usage is 0."""
    r = responses
    for c in ("input_tokens", "output_tokens"):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(0).cast("bigint"))
    if total_col and total_col in r.columns:
        r = r.withColumn("input_tokens", F.coalesce(F.col(total_col).cast("bigint"), F.lit(0)))
    return r.withColumns({"input_tokens": F.coalesce(F.col("input_tokens"), F.lit(0)).cast("bigint"),
                          "output_tokens": F.coalesce(F.col("output_tokens"), F.lit(0)).cast("bigint")}) \
            .withColumn("tokens_used", F.col("input_tokens") + F.col("output_tokens"))


def latest_attempt(responses: DataFrame, key: str = "key") -> DataFrame:
    """Last attempt per key; the aggregate holds numbers, the row is fetched late."""
    last = responses.groupBy(key).agg(F.max("attempt").alias("attempt"))
    w = Window.partitionBy(key, "attempt").orderBy(F.col("error").isNotNull(), "request_id")
    return (responses.join(last, [key, "attempt"], "left_semi").withColumn("_nth", F.row_number().over(w))
            .filter("_nth = 1").select(key, *[c for c in responses.columns if c != key]))


def by_prompt(requests: DataFrame) -> DataFrame:
    """One request per distinct prompt, keyed by its hash."""
    return dedupe_requests(requests).withColumn("key", F.col("prompt_hash"))


def to_keys(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses keyed by prompt hash -> one for every request's own key."""
    asked = requests.select("key", "prompt_hash").distinct()
    return asked.join(responses.withColumnRenamed("key", "prompt_hash"), "prompt_hash").drop("prompt_hash")


def _accepted(accept: Callable | None) -> Column:
    """Whether an answer counts: it came without an error and, where a stage
    parses it, ``accept(text)`` holds."""
    good = F.col("error").isNull()
    return good if accept is None else good & F.coalesce(accept(F.col("text")), F.lit(False))


def retry_plan(requests: DataFrame, responses: DataFrame, max_attempts: int = 3, accept: Callable | None = None) -> DataFrame:
    """Requests to (re)issue: keys never answered, and keys without an
    accepted answer while attempts remain.  ``accept`` turns the answer's text
    into a condition (a parse that must succeed); without it an answer
    without an error is accepted."""
    last = (responses.select("key", "attempt", _accepted(accept).alias("_ok")).groupBy("key")
            .agg(F.max("attempt").alias("_last"), F.max(F.col("_ok").cast("int")).alias("_ok")))
    due = requests.join(last, "key", "left").filter(
        F.col("_last").isNull() | ((F.col("_ok") == 0) & (F.col("_last") < max_attempts)))
    return (due.withColumn("attempt", F.coalesce(F.col("_last") + 1, F.lit(1)).cast("int"))
               .withColumn("request_id", F.concat_ws(":", F.col("stage"), F.col("key").cast("string"),
                                                     F.col("attempt").cast("string")))
               .drop("_last", "_ok"))


def attach_responses(df: DataFrame, responses: DataFrame, key: str, out: str, default: Column | None = None,
                     keep_usage: bool = True, accept: Callable | None = None) -> DataFrame:
    """Left-join one response per key: the latest accepted one, else the
    latest that came without an error, else none; a row without one gets
    ``default`` (the stage's failure value) and the latest ``error``.  Rows
    are never lost.

    The aggregate per key holds attempt numbers only; the answer's text is
    fetched by (key, attempt) and shuffled once.  ``responses`` is read twice,
    so it must be a stored table (the jobs store every answer), not a lazy
    model call.  Response fields are joined under private names, so input
    columns such as ``text`` never collide; bookkeeping columns left by an
    earlier stage (``error``, token counts) are replaced."""
    good = F.col("error").isNull()
    wanted = (responses.select("key", "attempt", good.alias("_good"), _accepted(accept).alias("_ok")).groupBy("key")
              .agg(F.max(F.when(F.col("_ok"), F.col("attempt"))).alias("_acc"), F.max(F.when(F.col("_good"), F.col("attempt"))).alias("_good"),
                   F.max("attempt").alias("_last"))
              .select(F.col("key").alias("_sg_key"), F.coalesce("_acc", "_good", "_last").alias("_sg_want")))
    met = responses.join(wanted, (F.col("key") == F.col("_sg_key")) & (F.col("attempt") == F.col("_sg_want")))
    # an attempt answered twice counts once
    w = Window.partitionBy("_sg_key", "_sg_want").orderBy(F.col("error").isNotNull(), "request_id", F.xxhash64("text"))
    last = met.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(
        F.col("_sg_key").alias(key), good.alias("_sg_ok"), F.col("text").alias("_sg_text"), F.col("input_tokens").alias("_sg_in"),
        F.col("output_tokens").alias("_sg_out"), F.col("error").alias("_sg_err"))
    stale = [c for c in (out, "error", "tokens_used", "input_tokens", "output_tokens") if c in df.columns]
    j = df.drop(*stale).join(last, key, "left")
    ok = F.coalesce(F.col("_sg_ok"), F.lit(False))
    dflt = default if default is not None else F.lit(None).cast("string")
    res = j.withColumns({
        out: F.when(ok, F.col("_sg_text")).otherwise(dflt),
        "error": F.when(~ok, F.coalesce(F.col("_sg_err"), F.lit("no response"))),
        "input_tokens": F.when(ok, F.coalesce(F.col("_sg_in"), F.lit(0))).otherwise(0).cast("bigint"),
        "output_tokens": F.when(ok, F.coalesce(F.col("_sg_out"), F.lit(0))).otherwise(0).cast("bigint"),
    }).withColumn("tokens_used", (F.col("input_tokens") + F.col("output_tokens")).cast("bigint"))
    res = res.drop("_sg_ok", "_sg_text", "_sg_in", "_sg_out", "_sg_err")
    return res if keep_usage else res.drop("input_tokens", "output_tokens")


def answer_in_batches(requests: DataFrame, chat_fn: Callable, path: str, save_interval: int = 10_000, max_attempts: int = 3,
                      accept: Callable | None = None) -> DataFrame:
    """Ask every distinct prompt until an answer is accepted, three
    times at most, ``save_interval`` prompts to a batch.  A batch's answers are
    committed before the next batch is asked (``sources.ledger``): a run that
    dies is continued by running it again, which asks the unfinished batch and
    those after it.  Returns the stored answers, keyed by prompt hash.

    ``requests`` is a stored table.  The distinct prompts are written once, by
    the part that follows from their hash and their number; a batch reads its
    part of them and that part's answers, so its cost does not grow with the
    run.  A batch's name holds the fingerprint of the prompts it asks, so other
    requests under the same path never replace answers."""
    spark = requests.sparkSession
    ledger = BatchLedger(spark, path)
    n = requests.select("prompt_hash").distinct().count()
    parts = max(1, -(-n // save_interval))
    part = F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)).cast("int")
    at = f"{path.rstrip('/')}/prompts"
    by_prompt(requests).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(at)
    if not n:  # no request at all
        return spark.createDataFrame([], RESPONSE_SCHEMA.replace("key bigint", "key string"))
    prompts = spark.read.parquet(at)

    def due(asked: DataFrame, answered: DataFrame | None) -> DataFrame:
        return asked.withColumn("attempt", F.lit(1)) if answered is None else retry_plan(asked, answered, max_attempts, accept)

    for _ in range(max_attempts):
        # one row per batch of the earliest attempt that is due
        plan = fingerprint(due(prompts, ledger.read()), "prompt_hash", by=["attempt", "part"]).orderBy("attempt", "part").collect()
        if not plan:
            break
        for batch in (b for b in plan if b["attempt"] == plan[0]["attempt"]):
            mine = f"{batch['part']}of{parts}"
            # its part's answers, and those given when there were more or fewer parts
            seen = ledger.read(lambda name: name.split("-")[1] == mine or not name.split("-")[1].endswith(f"of{parts}"))
            todo = due(prompts.filter(F.col("part") == batch["part"]), seen)
            asked = todo.filter(F.col("attempt") == batch["attempt"]).drop("part")
            ledger.write(f"{batch['attempt']}-{mine}-{batch['fingerprint']}", infer(asked, chat_fn, max_attempts=1))
    return ledger.read().drop("batch")


def stamp_output(df: DataFrame, model: str) -> DataFrame:
    """model_used and timestamp on every stage row."""
    return df.withColumns({"model_used": F.lit(model), "timestamp": F.current_timestamp()})


def stub_verdict_model(messages, model):
    """A deterministic offline model for tests and dry runs: answers one
    verdict line per numbered line of the last message ('n. Yes - stub' for
    odd n); raises on prompts containing FAIL to exercise the error path."""
    import re
    text = messages[-1]["content"]
    if "FAIL" in text:
        raise RuntimeError("stub failure")
    n = len(re.findall(r"(?m)^\d+\.", text))
    body = "\n".join(f"{i}. {'Yes' if i % 2 else 'No'} - stub" for i in range(1, n + 1))
    return body, len(text.split()), n


def offline_responses(df: DataFrame, key: str, text: str, error: str | None = None, stage: str = "offline",
                      attempt: int = 1) -> DataFrame:
    """A response table from an offline result file already loaded as a
    DataFrame (key, text[, error]); output tokens = whitespace tokens."""
    from specgrade.functions.text import word_count
    err = F.col(error) if error else F.lit(None).cast("string")
    return df.select(F.concat_ws(":", F.lit(stage), F.col(key).cast("string"), F.lit(str(attempt))).alias("request_id"),
                     F.col(key).alias("key"), F.lit(attempt).alias("attempt"),
                     F.when(err.isNull(), F.col(text)).alias("text"), F.lit(0).cast("bigint").alias("input_tokens"),
                     F.when(err.isNull(), word_count(text)).otherwise(F.lit(0)).cast("bigint").alias("output_tokens"),
                     err.alias("error"))


def stub_constraint_model(messages, model):
    """A deterministic offline model for constraint generation: 'Main Task:'
    plus 39 numbered constraints built from the prompt's words."""
    words = [w for w in messages[-1]["content"].split() if w.isalpha()] or ["text"]
    items = "\n".join(f"{i}. Mention '{words[i % len(words)]}'." for i in range(1, 40))
    return f"Main Task: Write about {words[0]}\nConstraints:\n{items}", len(words), 40


def stub_text_model(messages, model):
    """A deterministic offline model for free-text stages (merge, base, fit,
    summary): echoes the last half of the prompt."""
    text = messages[-1]["content"]
    return text[len(text) // 2:], len(text.split()), max(1, len(text.split()) // 2)
