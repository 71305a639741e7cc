"""Compressed input, resumable writes, feature cache, user-model embedding,
incremental streaming and partition independence of whole queries."""

import gzip
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from specgrade.operators import features as FE
from specgrade.plans.catalog import QUERIES
from specgrade.sources import corpus as SC
from specgrade.sources import usage_log as UL
from specgrade.streaming.usage import read_usage_totals, usage_totals_stream

from conftest import SF01

import sys  # noqa: E402

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tmp():
    return tempfile.mkdtemp(prefix="sg-test-", dir="/tmp")


def test_read_gz_corpus(spark):
    d = _tmp()
    with gzip.open(f"{d}/part.json.gz", "wt") as f:
        for i in range(5):
            f.write(json.dumps({"id": str(i), "text": "t" * (i + 1), "source": "s",
                                "metadata": {"url": f"https://x{i}.wordpress.com/"}}) + "\n")
    good, bad = SC.read_compressed_corpus(spark, d, "gz")
    assert good.count() == 5 and bad.count() == 0
    with pytest.raises(ValueError, match="supported codecs"):
        SC.read_compressed_corpus(spark, d, "zst")


def test_write_stage_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, "b")], "k bigint, t string")
    SC.write_stage(df, d + "/p")
    SC.write_stage(df, d + "/c", fmt="csv")
    assert sorted(spark.read.parquet(d + "/p").collect()) == sorted(df.collect())
    back = SC.read_stage_csv(spark, d + "/c", "k bigint, t string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_checkpointed_append_resumes(spark):
    d = _tmp() + "/out"
    first = spark.createDataFrame([(i,) for i in range(5)], "k bigint")
    SC.checkpointed_append(first, d, "k")
    more = spark.createDataFrame([(i,) for i in range(8)], "k bigint")
    out = SC.checkpointed_append(more, d, "k")
    assert sorted(r["k"] for r in out.collect()) == list(range(8))  # no duplicates after resume


def test_feature_cache_computes_only_missing(spark):
    d = _tmp() + "/cache"
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("f", F.col("k") * 2)

    key = SC.feature_key("m", {"dim": 4}, "input-v1")
    a = spark.createDataFrame([(i,) for i in range(4)], "k bigint")
    SC.cached_features(a, "k", compute, d, key)
    b = spark.createDataFrame([(i,) for i in range(6)], "k bigint")
    out = SC.cached_features(b, "k", compute, d, key)
    assert calls == [4, 2]
    assert sorted(r["f"] for r in out.collect()) == [0, 2, 4, 6, 8, 10]
    assert SC.feature_key("m", {"dim": 4}, "input-v2") != key


def _toy_model():
    # defined here, so ship it by value to the Python workers
    def enc(texts):
        return [[float(len(t)), 1.0] for t in texts]
    return enc


def test_embed_with_user_model(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    out = FE.embed_with(df, "text", _toy_model, 2).collect()
    assert [r["embedding"] for r in out] == [[2.0, 1.0], [4.0, 1.0]]


def test_usage_stream_is_incremental(spark):
    base = _tmp()
    events = spark.read.parquet(f"{SF01}/events.parquet")
    lines = UL.usage_lines(events)
    lines.filter(F.col("value").contains(" | click | ")).coalesce(1).write.text(base + "/in/a")
    q = usage_totals_stream(spark, base + "/in/*", base + "/out", base + "/ck")
    q.awaitTermination()
    first = {r["provider"]: r["tokens"] for r in read_usage_totals(spark, base + "/out").collect()}
    assert set(first) == {"click"}
    lines.filter(~F.col("value").contains(" | click | ")).coalesce(1).write.text(base + "/in/b")
    q = usage_totals_stream(spark, base + "/in/*", base + "/out", base + "/ck")
    q.awaitTermination()
    got = {r["provider"]: r["tokens"] for r in read_usage_totals(spark, base + "/out").collect()}
    want = {r["provider"]: r["tokens"] for r in QUERIES["usage_rollup"](spark, SF01).collect() if r["provider"]}
    assert got == want


@pytest.mark.parametrize("name", ["distinct_pairs", "dedupe_first", "row_number", "satisfaction_summary",
                                  "knn_pairs", "retry_plan", "find_pairs", "knn_top10", "embed_knn",
                                  "sample_rows", "take_first", "zip_join", "ab_order"])
def test_partition_independent(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(repr, QUERIES[name](spark, SF01).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(map(repr, QUERIES[name](spark, SF01).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_url_manifest_and_pending(spark):
    from specgrade.sources import manifest as M
    urls = M.urls_from_string(spark, " https://x.org/a/dump1.json.gz , ,https://x.org/b/dump2.jsonl.zst,https://x.org/a/dump1.json.gz")
    man = M.url_manifest(urls)
    got = sorted((r["url"], r["file_name"]) for r in man.collect())
    assert got == [("https://x.org/a/dump1.json.gz", "dump1.json.gz"), ("https://x.org/b/dump2.jsonl.zst", "dump2.jsonl.zst")]
    present = spark.createDataFrame([("dump1.json.gz", 10), ("dump2.jsonl.zst", 0)], "file_name string, size bigint")
    assert [r["file_name"] for r in M.pending_downloads(man, present).collect()] == ["dump2.jsonl.zst"]
    names = spark.createDataFrame([("a.jsonl.zst",), ("a.json.gz",), ("a.txt",), ("a.json.jsonl",), ("a.x.gz",)], "n string")
    out = [r["o"] for r in names.select(M.output_name("n").alias("o")).collect()]
    assert out == ["a.json.jsonl", "a.json.jsonl", None, None, "a.x.jsonl"]
