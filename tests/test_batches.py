"""Batches with commits: a writer that dies, retries decided by a parse,
features by content, running totals and quarantine of streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from specgrade import jobs
from specgrade.functions import scoring as S
from specgrade.operators import inference as I
from specgrade.operators import stages as SG
from specgrade.plans.tables import pair_eval_text
from specgrade.sources.ledger import BatchLedger, fingerprint

from conftest import SF01


def counting_chat(folder, answer=lambda body, nth: body.upper()):
    """A model that leaves a file per call; ``answer`` gets how often the prompt was asked."""
    def chat(messages, model):
        import hashlib
        body = messages[-1]["content"]
        mark = hashlib.md5(body.encode()).hexdigest()
        nth = sum(p.name.startswith(mark) for p in folder.iterdir()) + 1
        (folder / f"{mark}-{uuid.uuid4().hex}").touch()
        return answer(body, nth), 1, 1
    return chat


def requests(spark, n, path):
    df = spark.createDataFrame([(i, f"prompt {i // 2}") for i in range(n)], "key long, p string")
    I.build_requests(df, "s", "key", "{p}", {"p": "p"}).write.parquet(path)
    return spark.read.parquet(path)


def test_a_writer_that_dies_between_batches(spark, tmp_path, monkeypatch):
    """60 prompts in 6 batches; the third commit fails.  The rerun asks that
    batch and the ones after it, nothing twice is in the table."""
    calls = tmp_path / "calls"
    calls.mkdir()
    reqs = requests(spark, 120, str(tmp_path / "requests"))
    path, commit, done = str(tmp_path / "answers"), BatchLedger.commit, []

    def dies(self, batch, n_rows):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append((batch, n_rows))
        commit(self, batch, n_rows)

    monkeypatch.setattr(BatchLedger, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        I.answer_in_batches(reqs, counting_chat(calls), path, save_interval=10)
    asked = len(list(calls.iterdir()))
    committed = sum(n for _, n in done)
    assert committed < asked < 60
    assert BatchLedger(spark, path).read().count() == committed  # the unfinished batch is not seen
    monkeypatch.setattr(BatchLedger, "commit", commit)
    got = I.answer_in_batches(reqs, counting_chat(calls), path, save_interval=10).collect()
    assert len(got) == len({r.key for r in got}) == 60 and all(r.text.startswith("PROMPT") for r in got)
    assert len(list(calls.iterdir())) == asked + (60 - committed)  # only what was not committed
    I.answer_in_batches(reqs, counting_chat(calls), path, save_interval=10)
    assert len(list(calls.iterdir())) == asked + (60 - committed)  # nothing on a third run


def test_other_requests_never_replace_answers(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = str(tmp_path / "answers")
    I.answer_in_batches(requests(spark, 10, str(tmp_path / "a")), counting_chat(calls), path, save_interval=100)
    got = I.answer_in_batches(requests(spark, 30, str(tmp_path / "b")), counting_chat(calls), path, save_interval=100)
    assert got.count() == 15 and len(list(calls.iterdir())) == 15
    # more parts than before: still nothing is asked twice
    got = I.answer_in_batches(requests(spark, 80, str(tmp_path / "e")), counting_chat(calls), path, save_interval=8)
    assert got.count() == len({r.key for r in got.collect()}) == 40 and len(list(calls.iterdir())) == 40
    none = requests(spark, 30, str(tmp_path / "c")).limit(0)
    assert I.answer_in_batches(none, counting_chat(calls), str(tmp_path / "d")).count() == 0


def test_answers_are_asked_until_they_parse(spark, tmp_path):
    """Prompts whose answers parse on attempt 1, 2, 3 and never."""
    calls = tmp_path / "calls"
    calls.mkdir()
    good = "Grammar: A 4, B 2\nCoherence: A 3, B 3\nLikability: A 1, B 5"
    chat = counting_chat(calls, lambda body, nth: good if nth >= int(body) else f"nothing on attempt {nth}")
    pairs = spark.createDataFrame([(i, str(1 + i % 4)) for i in range(8)], "position long, p string")
    reqs = I.build_requests(pairs, "pairwise", "position", "{p}", {"p": "p"})
    resp = jobs._responses(spark, reqs, str(tmp_path / "out"), chat, accept=S.has_pair_scores)
    out = {r.position: r for r in SG.pairwise_results(pairs, resp, "position").collect()}
    assert len(list(calls.iterdir())) == 1 + 2 + 3 + 3
    for i, r in out.items():
        assert r.needs_parsing == (1 if i % 4 == 3 else 0) and r.error is None
        assert r.evaluations_raw == ("nothing on attempt 3" if i % 4 == 3 else good)
        assert (r.grammar_score_A, r.overall_pref) == ((None, None) if i % 4 == 3 else (4.0, "A"))


def test_has_pair_scores_is_the_parse(spark):
    odd = ["", "Grammar", "Grammar 1", "Grammar: A 3", "Grammar: 3 4", "Grammar A: 3\nCoherence B: 4", "likability 1 2", "Coherence\rA - 3,5\rB - 2", "GRAMMAR 5/5", "x 1 2 3", None]
    df = pair_eval_text(spark, SF01).select("evaluation").unionByName(spark.createDataFrame([(t,) for t in odd], "evaluation string"))
    for mode in ("fixed", "compat"):
        parsed = S.with_pair_scores(df, "evaluation", mode, "p")
        for r in parsed.select("evaluation", "p", S.has_pair_scores("evaluation").alias("found")).collect():
            assert bool(r.found) == (r.p is not None), r.evaluation


def test_late_fetch_keeps_every_row(spark):
    """Duplicate attempts, errors after answers, unanswered rows, null keys."""
    rows = [("r1", 1, 1, "old", 1, 1, None), ("r2", 1, 2, None, 0, 0, "boom"), ("r3", 2, 1, None, 0, 0, "first"), ("r4", 2, 2, None, 0, 0, "second"),
            ("r5", 3, 1, "a", 1, 1, None), ("r5", 3, 1, "a", 1, 1, None), ("r6", 3, 1, "b", 2, 2, None), ("r7", 9, 1, "spare", 1, 1, None)]
    resp = spark.createDataFrame(rows, "request_id string, key long, attempt int, text string, input_tokens long, output_tokens long, error string")
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w"), (4, "v"), (None, "u")], "key long, v string")
    got = {(r.key, r.v): (r.out, r.error, r.tokens_used) for r in I.attach_responses(df, resp, "key", "out", F.lit("-")).collect()}
    assert got == {(1, "x"): ("old", None, 2), (1, "y"): ("old", None, 2), (2, "z"): ("-", "second", 0), (3, "w"): ("a", None, 2),
                   (4, "v"): ("-", "no response", 0), (None, "u"): ("-", "no response", 0)}
    last = {r.key: (r.attempt, r.text) for r in I.latest_attempt(resp).collect()}
    assert last == {1: (2, None), 2: (2, None), 3: (1, "a"), 9: (1, "spare")}


def test_fingerprints_add_up(spark):
    df = spark.range(1000).withColumn("t", F.col("id").cast("string"))
    whole = fingerprint(df, "id", "t").first()[0]
    assert whole == fingerprint(df.repartition(7).orderBy(F.rand()), "id", "t").first()[0]
    assert whole != fingerprint(df.withColumn("t", F.when(F.col("id") == 5, "x").otherwise(F.col("t"))), "id", "t").first()[0]
    assert fingerprint(df.limit(0), "id").first()[0].startswith("0-")
