"""Remaining FIXTURES.md cases: length boundaries, vector edge cases, count
fallbacks, length tolerance rules, compression edge cases, validators."""

import pytest
from pyspark.sql import functions as F

from specgrade.functions import lists as L
from specgrade.operators import corpus as C
from specgrade.operators import inference as I
from specgrade.operators import pairing as P
from specgrade.operators import quality as Q
from specgrade.operators import stages as SG


def test_length_band_boundaries(spark):
    rows = [(str(n), "https://blog.x.org/", "a" * n) for n in (999, 1000, 2000, 2001)]
    rows += [("ws", "https://blog.x.org/", "   "), ("empty", "https://blog.x.org/", ""),
             ("nl", "https://blog.x.org/", "\n" + "b" * 999 + "\nc\n")]
    df = spark.createDataFrame(rows, "id string, url string, text string")
    got = {r["id"]: r["text_length"] for r in C.parse_corpus(df, 1000, 2000).collect()}
    assert got == {"1000": 1000, "2000": 2000, "nl": 1001}


def test_vector_edge_cases(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert v.select(P.l2_normalize("embedding").alias("u")).collect()[0]["u"] is None  # zero vector
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (1, 4)], "i bigint, j bigint")
    sims = {(r["i"], r["j"]): r["similarity"] for r in P.score_edges(edges, v).collect()}
    assert (0, 1) not in sims                      # zero vector excluded
    assert sims[(1, 2)] == pytest.approx(1.0)      # duplicates
    assert sims[(1, 3)] == pytest.approx(-1.0)     # opposite
    assert sims[(1, 4)] == pytest.approx(0.0)


COUNT_CASES = [
    ("\n".join(f"{i}. c" for i in range(1, 40)), 39, 39),
    ("\n".join(f"{i}. c" for i in range(1, 39)), 38, 38),
    ("\n".join(f"{i}. c" for i in range(1, 41)), 40, 40),
    ("  1. a\n  2. b", 0, 2),          # leading spaces: T4 misses them, T5 trims first
    ("1. a 2. b 3. c", 1, 1),          # inline list
    ("Constraints:\n1. a\n2 b", 1, 2),  # T5 needs no dot, skips the 'Constraint' line
    ("1. a\r\n2. b\r\n", 2, 2),         # CR line ends
]


@pytest.mark.parametrize("text,t4,t5", COUNT_CASES)
def test_count_fallbacks(spark, text, t4, t5):
    r = spark.createDataFrame([(text,)], "t string").select(
        L.count_numbered("t").alias("t4"), L.count_digit_lines("t").alias("t5")).first()
    assert (r["t4"], r["t5"]) == (t4, t5)


def test_base_length_tolerance(spark):
    df = spark.createDataFrame(
        [(1, "task", "x" * 100, 110, 5), (2, "task", "x" * 100, 111, 5), (3, "task", "x" * 100, 100, 0),
         (0, "task", "x", 1, 1)],
        "instruction_number bigint, main_task string, base_content string, content_length bigint, tokens_used bigint"
    ).withColumns({"model_used": F.lit("m"), "timestamp": F.current_timestamp()})
    v = {r["instruction_number"]: r["rule_id"] for r in Q.validate(df, "base_generated", "instruction_number").collect()}
    assert v == {2: "V10", 3: "V11", 0: "V7"}


def test_float_typed_key_fails_integer_rule(spark):
    df = spark.createDataFrame([(1.0, "1. a", "t")], "instruction_number double, constraints string, main_task string") \
        .withColumns({"instruction": F.lit("i"), "model_used": F.lit("m"), "timestamp": F.current_timestamp()})
    v = Q.validate(df, "constraints", "instruction_number").collect()
    assert [r["rule_id"] for r in v] == ["V7"]


def test_missing_columns_error(spark):
    df = spark.createDataFrame([(1,)], "instruction_number bigint")
    with pytest.raises(Q.MissingColumnsError, match="main_task"):
        Q.validate(df, "constraints", "instruction_number")


def test_evaluation_rate_null_fails_v16(spark):
    rows = [(1, 39, 20, None, "\n".join(f"{i}. Yes - r" for i in range(1, 40)))]
    df = spark.createDataFrame(rows, "instruction_number bigint, total_constraints bigint, num_satisfied bigint, "
                                     "satisfaction_rate double, satisfaction_results string") \
        .withColumns({"fitted_content": F.lit("x"), "constraints": F.lit("x"), "model_used": F.lit("m"),
                      "tokens_used": F.lit(1), "timestamp": F.current_timestamp()})
    assert [r["rule_id"] for r in Q.validate(df, "evaluation", "instruction_number").collect()] == ["V16"]


def test_summarize_edge_cases(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "keep me")], "k bigint, fitted_content string")
    resp = I.offline_responses(spark.createDataFrame([(1, "abcde"), (2, "x")], "k bigint, text string"), "k", "text")
    out = {r["k"]: r for r in SG.summarize_results(df, resp, "k").collect()}
    assert out[1]["compression_ratio"] == 0.5
    assert out[2]["compression_ratio"] == 0.0            # empty original
    assert out[3]["compression_ratio"] == 1.0            # failed row keeps the original
    assert out[3]["summarized_content"] == "keep me" and out[3]["error"] == "no response"


def test_fit_fanout_modes(spark):
    cons = spark.createDataFrame([(1, s) for s in (7, 15)], "instruction_number bigint, subset_size int")
    base = spark.createDataFrame([(1, "b1"), (1, "b2")], "instruction_number bigint, base_content string")
    from specgrade.operators import joins as J
    assert J.join_constraints_base(cons, base).count() == 2
    assert J.join_constraints_base(cons, base, dedupe_right=False).count() == 4
