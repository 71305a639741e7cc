"""The stage jobs chained end to end with the deterministic stub models."""

import tempfile

from pyspark.sql import functions as F

from specgrade import jobs
from specgrade.operators import inference as I
from specgrade.plans.tables import write_corpus_jsonl

from conftest import SF01


def test_ingest_counts_lines_not_ids(spark, tmp_path):
    good = '{"id": "a", "text": "%s", "metadata": {"url": "https://x.wordpress.com/p"}}' % ("t" * 20)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.jsonl").write_text("\n".join([good, good, good, good.replace('"a"', "null"), "{broken"]))
    total = jobs.parse_blogs(spark, str(tmp_path / "in"), str(tmp_path / "raw"), 1, 100).filter(F.col("file").isNull()).first()
    assert (total["lines"], total["kept"]) == (5, 4)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4


def test_one_call_per_distinct_prompt_and_none_on_a_rerun(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def chat(messages, model):
        import hashlib
        import uuid
        body = messages[-1]["content"]
        first = not any(p.name.startswith(hashlib.md5(body.encode()).hexdigest()) for p in calls.iterdir())
        (calls / f"{hashlib.md5(body.encode()).hexdigest()}-{uuid.uuid4().hex}").touch()
        if "flaky" in body and first:
            raise RuntimeError("try again")
        return I.stub_verdict_model(messages, model)

    rows = [(1, 2, "1. a\n2. b", "text"), (1, 3, "1. a\n2. b", "text"), (2, 1, "1. a", "flaky"), (3, 1, "1. a", "FAIL")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "instruction_number long, subset_size long, constraints string, fitted_content string").write.parquet(src)
    summary = jobs.evaluate(spark, src, out, chat_fn=chat)
    summary.collect()
    summary.collect()
    assert len(list(calls.iterdir())) == 1 + 2 + 3  # one prompt for two rows, a retry, three failures
    got = {(r.instruction_number, r.subset_size): r for r in spark.read.parquet(out).collect()}
    assert got[(1, 2)].num_satisfied == got[(1, 3)].num_satisfied == got[(2, 1)].num_satisfied == 1
    assert (got[(3, 1)].num_satisfied, got[(3, 1)].satisfaction_results, got[(3, 1)].satisfaction_rate) == (0, "", None)
    jobs.evaluate(spark, src, out, chat_fn=chat)
    assert len(list(calls.iterdir())) == 6


def test_constraint_study_chain(spark):
    d = tempfile.mkdtemp(prefix="sg-jobs-", dir="/tmp")
    write_corpus_jsonl(spark, SF01, d + "/dump")
    stats = jobs.parse_blogs(spark, d + "/dump", d + "/raw", 200, 5000, glob="*.txt")
    assert stats.filter(F.col("file").isNull()).first()["lines"] == 1000  # every line, 20 malformed ones too
    ps = jobs.find_blog_pairs(spark, d + "/raw", d + "/pairs", max_size=200, max_pairs=10, lo=-1.0, hi=1.0)
    n_pairs = ps.first()["n_pairs"]
    assert 0 < n_pairs <= 10
    jobs.merge_blogs(spark, d + "/pairs", d + "/merged", chat_fn=I.stub_text_model)
    gc = jobs.generate_constraints(spark, d + "/merged", d + "/constraints", chat_fn=I.stub_constraint_model)
    assert gc.first()["empty_parses"] == 0
    jobs.expand_constraint_buckets(spark, d + "/constraints", d + "/buckets")
    jobs.generate_base(spark, d + "/buckets", d + "/base", chat_fn=I.stub_text_model)
    jobs.fit_constraints(spark, d + "/buckets", d + "/base", d + "/fitted", chat_fn=I.stub_text_model)
    fitted = spark.read.parquet(d + "/fitted")
    assert fitted.count() == 5 * n_pairs
    assert fitted.filter(F.col("num_constraints") != F.col("subset_size")).count() == 0
    summary = jobs.evaluate(spark, d + "/fitted", d + "/eval.csv", chat_fn=I.stub_verdict_model).first()
    assert summary["n"] == 5 * n_pairs and 0.0 <= summary["mean_rate"] <= 1.0
    comp = jobs.summarize(spark, d + "/fitted", d + "/summary", chat_fn=I.stub_text_model).first()
    assert comp["n_rows"] == 5 * n_pairs
