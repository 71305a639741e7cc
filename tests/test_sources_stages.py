"""Sources (JSONL, CSV, usage logs), stream = batch, stub-model stage run."""

import json
import os
import tempfile

from specgrade.operators import corpus as C
from specgrade.operators import inference as I
from specgrade.operators import stages as SG
from specgrade.sources import corpus as SC
from specgrade.sources import usage_log as UL
from specgrade.streaming.usage import classify_stream


def _tmp():
    return tempfile.mkdtemp(prefix="sg-test-", dir="/tmp")


def _write_jsonl(d):
    lines = [
        json.dumps({"id": "1", "text": "x" * 1000, "source": "s", "metadata": {"url": "https://a.wordpress.com/p"}}),
        "{not json",
        json.dumps({"id": "2", "text": "short", "source": "s", "metadata": {"url": "https://blog.x.org/"}}),
        json.dumps({"id": "3", "text": "y" * 1500, "source": "s"}),
        json.dumps({"id": "4", "text": "z" * 1200, "source": "s", "metadata": None}),
        json.dumps({"id": "5", "text": " \n" + "w" * 1100 + "\n", "source": "s",
                    "metadata": {"url": "https://example.org/blog/x"}}),
    ]
    os.makedirs(f"{d}/sub", exist_ok=True)
    with open(f"{d}/sub/a.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_read_corpus_and_parse(spark):
    d = _write_jsonl(_tmp())
    good, bad = SC.read_corpus_jsonl(spark, d)
    assert bad.count() == 1
    out = C.parse_corpus(good, 1000, 2000)
    got = {r["id"]: r["text_length"] for r in out.collect()}
    assert got == {"1": 1000, "5": 1100}


def test_stream_equals_batch(spark):
    d = _write_jsonl(_tmp())
    out, ck = _tmp() + "/out", _tmp() + "/ck"
    q = classify_stream(spark, d + "/sub", out, ck, 1000, 2000)
    q.awaitTermination()
    good, _ = SC.read_corpus_jsonl(spark, d)
    batch = sorted(r["id"] for r in C.parse_corpus(good, 1000, 2000).collect())
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == batch


def test_stage_csv_quoted_newlines(spark):
    p = _tmp() + "/t.csv"
    with open(p, "w") as f:
        f.write('instruction_number,constraints\n1,"1. a\n2. ""b"""\n2,\n')
    df = SC.read_stage_csv(spark, p, "instruction_number bigint, constraints string")
    rows = sorted(df.collect())
    assert rows[0]["constraints"] == '1. a\n2. "b"' and rows[1]["constraints"] is None
    df2 = SC.read_stage_csv(spark, p, "instruction_number bigint, constraints string", empty_as_null=False)
    assert sorted(df2.collect())[1]["constraints"] == ""


def test_usage_log_formats(spark):
    rows = [("2024-01-01 00:00:01 | openai | m | 12",), ("2024-01-01 00:00:02 | claude | m | 5 | {'a': 1}",),
            ("2024-01-01 00:00:03 | bad | 7",), ("2024-01-01 00:00:04 | x | m | notanint",)]
    p = UL.parse_usage(spark.createDataFrame(rows, "value string"))
    got = sorted((r["provider"], r["tokens"], r["metadata"]) for r in p.collect())
    assert got == [("claude", 5, "{'a': 1}"), ("openai", 12, None)]
    leg = spark.createDataFrame([("01-02-2024 10:00:00 : 42",), ("bad line",)], "value string")
    assert [r["u"]["tokens"] for r in leg.select(UL.parse_legacy_line().alias("u")).collect() if r["u"]] == [42]


def test_stub_model_end_to_end(spark):
    df = spark.createDataFrame([(1, "text one", "1. a\n2. b\n3. c"), (2, "FAIL", "1. a")],
                               "instruction_number bigint, fitted_content string, constraints string")
    reqs = SG.evaluate_requests(df, "instruction_number")
    resp = I.infer(reqs, I.stub_verdict_model, max_attempts=2)
    ev = {r["instruction_number"]: r for r in SG.evaluate_results(df, resp, "instruction_number").collect()}
    assert ev[1]["total_constraints"] == 3 and ev[1]["num_satisfied"] >= 1 and ev[1]["error"] is None
    assert ev[2]["satisfaction_rate"] is None and "stub failure" in ev[2]["error"]
    plan = I.retry_plan(reqs, resp, 3)
    assert [r["key"] for r in plan.collect()] == [2]
