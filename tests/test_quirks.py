"""
blank (Q7), zero pairs still give a typed table (Q22), and a failed upstream
row (null text) never aborts a downstream stage (Q23)."""

from pyspark.sql import functions as F

from specgrade.operators import lists as OL
from specgrade.operators import pairing as P
from specgrade.operators import quality as Q
from specgrade.operators import stages as SG


def test_q7_null_text_is_blank(spark):
    df = spark.createDataFrame(
        [(1, "https://a.org/blog/x", "s", None, 1200), (2, "https://a.org/blog/y", "s", "  ", 1200),
         (3, "https://a.org/blog/z", "s", "text", 1200)],
        "id long, url string, source string, text string, text_length long")
    got = {r["id"]: r["rule_id"] for r in Q.validate(df, "raw_blogs", "id").collect()}
    assert got == {1: "V2", 2: "V2"}


def test_q22_zero_pairs_is_an_empty_typed_table(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(30)],
                              "vec_id long, embedding array<double>")
    for pairs in (P.find_pairs(e, 0.40, 0.50, 25, k=10), P.find_pairs_distinct(e, 0.40, 0.50, 25, k=10)):
        assert pairs.count() == 0  # orthogonal or equal vectors: cosine 0 or 1, never in the band
        out = str(tmp_path / f"p{id(pairs)}")
        pairs.write.parquet(out)
        back = spark.read.parquet(out)
        assert back.columns == ["blog_1_id", "blog_2_id", "similarity"] and back.count() == 0


def test_q23_null_upstream_text_flows_through(spark):
    c = spark.createDataFrame([(1, None), (2, "1. a\n2. b")], "instruction_number long, constraints string")
    exp = {(r["instruction_number"], r["subset_size"]) for r in OL.expand_buckets(c).collect()}
    assert {s for k, s in exp if k == 1} == {0} and {s for k, s in exp if k == 2} == {2}
    fitted = spark.createDataFrame([(1, None), (2, "abcd")], "instruction_number long, fitted_content string")
    responses = spark.createDataFrame([], "request_id string, key long, attempt int, text string, "
                                          "input_tokens long, output_tokens long, error string")
    rows = {r["instruction_number"]: r for r in SG.summarize_results(fitted, responses, "instruction_number").collect()}
    assert rows[1]["original_length"] == 0 and rows[1]["error"] is not None
    assert rows[2]["summarized_content"] == "abcd" and rows[2]["error"] is not None
