"""Direct fits by key and by position, names, defaults, jobs, stage files."""

import warnings

import pytest
from pyspark.sql import functions as F

from specgrade import jobs
from specgrade.operators import inference as I
from specgrade.operators import joins as J
from specgrade.operators import stages as SG


def test_fit_direct_by_key_or_by_position(spark):
    cons = spark.createDataFrame([(2, "1. b"), (1, "1. a"), (3, "1. c")], "instruction_number long, constraints string")
    merged = spark.createDataFrame([(1, "one"), (2, "two")], "instruction_number long, merged_blog string")
    by_key = SG.fit_direct_pairs(cons, merged).collect()
    assert {(r.instruction_number, r.merged_blog) for r in by_key} == {(1, "one"), (2, "two")}
    plain = merged.withColumnRenamed("instruction_number", "at")
    with pytest.raises(ValueError, match="orders"):
        SG.fit_direct_pairs(cons, plain)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = SG.fit_direct_pairs(cons, plain, constraints_order=["instruction_number"], merged_order=["at"]).collect()
    assert any("3 vs 2" in str(w.message) for w in said)
    assert sorted((r.position, r.constraints, r.merged_blog) for r in got) == [(1, "1. a", "one"), (2, "1. b", "two")]


def test_zip_join_duplicates_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None)], "k long, v string")
    right = spark.createDataFrame([(i % 2, "y", {"a": i}) for i in range(5)], "o long, w string, m map<string,int>")
    got = sorted(tuple(r)[:4] for r in J.zip_join(left, right, ["k"], ["o"], warn=False).collect())
    assert got == [(1, 1, "x", 0), (2, 1, "x", 0), (3, 1, "x", 0), (4, 2, None, 1)]


def test_dedupe_first_states_its_order(spark):
    rows = [(1, 2, "b", {"x": 1}), (1, 1, "a", {"x": 2, "y": 3}), (1, 1, "a", {"y": 3, "x": 2}), (None, 5, "n", None), (None, 4, "m", None)]
    df = spark.createDataFrame(rows, "k long, o long, v string, m map<string,int>")
    with pytest.raises(ValueError, match="order"):
        J.dedupe_first(df, "k", None)
    got = {r.k: (r.o, r.v) for r in J.dedupe_first(df, "k", "o").collect()}
    assert got == {1: (1, "a"), None: (4, "m")}
    assert J.dedupe_first(df, "k", "o").count() == 2


def test_replicate_left_deals_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row")).unionByName(
        spark.createDataFrame([(None, -1)], "k long, row long"))
    made = spark.createDataFrame([(7, "hot"), (1, "one")], "k long, text string")
    out = J.replicate_left(df, made, "k", ["text"], heavy=16)
    got = {(r.k, r.text): r.n for r in out.groupBy("k", "text").agg(F.count("*").alias("n")).collect()}
    assert got[(7, "hot")] == 1001 and got[(1, "one")] == 1 and got[(None, None)] == 1 and sum(got.values()) == 3001
    parts = out.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = J.replicate_left(df, made, "k", ["text"], heavy=16).filter("k = 7").select(F.spark_partition_id().alias("p")).distinct()
        assert parts.count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_default_columns_of_a_fit(spark):
    cons = spark.createDataFrame([(1, "t", "1. a")], "instruction_number long, main_task string, constraints string")
    base = spark.createDataFrame([(1, "t", "text")], "instruction_number long, main_task string, base_content string")
    text = SG.fit_requests(cons, base, constraint_col="absent", base_col="also_absent", order="main_task").first()["messages"][0]["content"]
    assert "1. a" in text and "text" in text
    with pytest.raises(ValueError):
        SG.fit_requests(cons.drop("constraints"), base, constraint_col="absent", order="main_task")


def test_names(spark):
    df = spark.createDataFrame([(1, "s", "c", 7)], "instruction_number long, summarized_content string, selected_constraints string, subset_size int")
    assert SG.to_evaluation_names(df).columns == ["instruction_number", "FinalGeneratedStory", "SelectedConstraints", "Number_of_Constraints"]
    merged = spark.createDataFrame([("a", "b", "m", 0.5)], "original_blog_1 string, original_blog_2 string, merged_blog string, similarity double")
    assert SG.to_legacy_names(merged).columns == ["Original Blog 1", "Original Blog 2", "Merged Blog", "Similarity"]


def test_later_jobs_and_csv_tables(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = [(1, "1. a\n2. b", 'text "one"\nnext'), (2, "1. c", ""), (3, "1. d", "three")]
    spark.createDataFrame(rows, "instruction_number long, constraints string, base_content string").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(at("in.csv"))
    assert dict(jobs.read_table(spark, at("in.csv")).dtypes)["instruction_number"] == "bigint"
    jobs.revise(spark, at("in.csv"), at("revised"), chat_fn=I.stub_text_model)
    out = {r.instruction_number: r for r in spark.read.parquet(at("revised")).collect()}
    assert out[1].revised_content and out[2].revised_content == "" and out[2].error is None
    spark.createDataFrame([("m1",), ("m2",)], "merged_blog string").write.parquet(at("merged"))
    jobs.fit_direct(spark, at("in.csv"), at("merged"), at("direct"), chat_fn=I.stub_text_model)
    assert spark.read.parquet(at("direct")).count() == 2

    def scores(messages, model):
        return "Grammar: A 1, B 2\nCoherence: A 1, B 2\nLikability: A 3, B 2", 1, 1
    spark.createDataFrame([(i, f"other {i}") for i in range(1, 4)], "instruction_number long, fitted_content string").write.parquet(at("other"))
    n = jobs.pairwise(spark, at("in.csv"), at("other"), at("judged"), chat_fn=scores).first()
    assert (n.n_pairs, n.n_unparsed) == (3, 0)
