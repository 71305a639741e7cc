"""Streams whose sink dies, quarantine, content-addressed features, long
domain lists and the one-pass ingest."""

import pytest
from pyspark.sql import functions as F

from specgrade import jobs
from specgrade.functions import urls as U
from specgrade.plans.catalog import QUERIES
from specgrade.plans.tables import table, write_corpus_jsonl
from specgrade.sources import usage_log as UL
from specgrade.sources.feature_table import FeatureTable
from specgrade.sources.ledger import BatchLedger
from specgrade.streaming import usage as US

from conftest import SF01


def totals(df):
    return {r["provider"]: (r["tokens"], r["calls"]) for r in df.collect() if r["provider"]}


def test_usage_totals_survive_a_sink_that_dies(spark, tmp_path, monkeypatch):
    """The second epoch dies after its rows are written, before the commit:
    the first epoch's totals stay readable; the rerun gives A11's totals."""
    lines = UL.usage_lines(spark.read.parquet(f"{SF01}/events.parquet"))
    at = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    lines.filter(F.col("value").contains(" | click | ")).coalesce(1).write.text(at["in"] + "/a")
    assert US.read_usage_totals(spark, at["out"]).count() == 0
    US.usage_totals_stream(spark, at["in"] + "/*", at["out"], at["ck"]).awaitTermination()
    first = totals(US.read_usage_totals(spark, at["out"]))
    assert set(first) == {"click"}
    lines.filter(~F.col("value").contains(" | click | ")).coalesce(1).write.text(at["in"] + "/b")
    commit = BatchLedger.commit
    monkeypatch.setattr(BatchLedger, "commit", lambda self, batch, n: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(Exception, match="dies"):
        US.usage_totals_stream(spark, at["in"] + "/*", at["out"], at["ck"]).awaitTermination()
    assert totals(US.read_usage_totals(spark, at["out"])) == first
    monkeypatch.setattr(BatchLedger, "commit", commit)
    US.usage_totals_stream(spark, at["in"] + "/*", at["out"], at["ck"]).awaitTermination()
    assert totals(US.read_usage_totals(spark, at["out"])) == totals(QUERIES["usage_rollup"](spark, SF01))


def test_stream_quarantine_is_exactly_once(spark, tmp_path, monkeypatch):
    """Several files, an epoch that dies: every kept row and malformed line once."""
    at = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    write_corpus_jsonl(spark, SF01, at["in"] + "/dump")
    (tmp_path / "in" / "dump" / "more.txt").write_text('{"id": 1\n{"id": "x", "text": "t", "metadata": {"url": "https://a.wordpress.com/"}}\nnot json\n')
    commit, done = BatchLedger.commit, []

    def dies(self, batch, n):
        if done:
            raise RuntimeError("dies")
        done.append(batch)
        commit(self, batch, n)

    monkeypatch.setattr(BatchLedger, "commit", dies)
    run = lambda: US.classify_stream_quarantine(spark, at["in"] + "/dump", at["out"], at["ck"], 0, None, max_files_per_trigger=1).awaitTermination()
    with pytest.raises(Exception, match="dies"):
        run()
    monkeypatch.setattr(BatchLedger, "commit", commit)
    run()
    bad = US.read_quarantine(spark, at["out"]).collect()
    whole = spark.read.text(at["in"] + "/dump")
    assert len(bad) == 2 + table(spark, SF01, "documents").filter("doc_id % 50 = 0").count()
    assert {r.line for r in bad} <= {r.value for r in whole.collect()}
    assert {r.line for r in bad if r.file.endswith("more.txt")} == {'{"id": 1', "not json"}
    kept = US.read_classified(spark, at["out"])
    ids = [r.id for r in kept.select("id").collect()]
    assert len(ids) == len(set(ids)) and "x" in ids
    # the batch filter over the same files
    from specgrade.operators.corpus import parse_corpus
    from specgrade.sources import corpus as SC
    good, _ = SC.read_corpus_jsonl(spark, at["in"] + "/dump", glob="*.txt")
    assert set(ids) == {r.id for r in parse_corpus(good, 0, None).select("id").collect()}


def features_of(calls):
    def compute(texts):
        rows = texts.collect()
        calls.append(sorted(r.text for r in rows))
        return texts.select("text_hash", F.length("text").alias("n"))
    return compute


def test_features_follow_the_content(spark, tmp_path):
    def docs(rows):
        return spark.createDataFrame(rows, "k long, text string")
    calls = []
    cache = FeatureTable(spark, str(tmp_path), "m", {"dim": 4})
    got = cache.update(docs([(1, "a"), (2, "bb"), (3, "bb"), (4, None)]), "k", features_of(calls)).collect()
    assert {(r.k, r.state, r.n) for r in got} == {(1, "new", 1), (2, "new", 2), (3, "new", 2), (4, "new", 0)}
    assert calls == [["", "a", "bb"]]  # a copy is computed once
    now = docs([(1, "a"), (2, "changed"), (3, "a"), (4, None), (5, "new")])
    got = {r.k: (r.state, r.computed, r.n) for r in cache.update(now, "k", features_of(calls)).collect()}
    assert got == {1: ("unchanged", False, 1), 2: ("changed", True, 7), 3: ("changed", False, 1), 4: ("unchanged", False, 0), 5: ("new", True, 3)}
    assert calls[1] == ["changed", "new"]
    again = cache.update(now, "k", features_of(calls)).collect()
    assert {r.state for r in again} == {"unchanged"} and len(calls) == 2
    back = {r.k: (r.state, r.n) for r in cache.update(docs([(2, "bb")]), "k", features_of(calls)).collect()}
    assert back == {2: ("changed", 2)} and calls[2:] == [[]]  # known from row 3's first text
    other = FeatureTable(spark, str(tmp_path), "m", {"dim": 8})
    assert {r.state for r in other.states(now, "k").collect()} == {"new"}


def test_feature_update_that_dies(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "k long, text string")
    cache, commit, calls = FeatureTable(spark, str(tmp_path), "m", {}), BatchLedger.commit, []

    def dies(self, batch, n):
        if self.path.endswith("/rows"):
            raise RuntimeError("dies")
        commit(self, batch, n)

    monkeypatch.setattr(BatchLedger, "commit", dies)
    with pytest.raises(RuntimeError):
        cache.update(df, "k", features_of(calls))
    monkeypatch.setattr(BatchLedger, "commit", commit)
    got = cache.update(df, "k", features_of(calls)).collect()
    assert len(got) == 20 and all(r.n == 6 for r in got)
    assert cache.texts.read().count() == 7


def test_long_domain_list_shuffles_no_common_suffix(spark):
    """Hosts that nearly all end in .com against 30,000 domains."""
    hosts = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("http://u"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".hot.com").otherwise(".site.com"), F.lit("/x")).alias("url"))
    domains = spark.range(30_000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".com")).alias("domain")).unionByName(
        spark.createDataFrame([("hot.com",), ("U7.site.com",), ("u8",)], "domain string"))
    found = U.suffix_candidates(hosts, domains, "k")
    common = {r[0]: r[1] for r in found.groupBy("_sg_sfx").count().collect()}
    assert "com" not in common and "site.com" not in common and common["hot.com"] == 6667
    # false hits of the filter are few
    assert sum(common.values()) < 6667 + 0.15 * 20_000
    # the exploded suffixes meet the filter before any exchange
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_sg_sfx" not in plan.split("Generate")[0]
    got = {r.k for r in U.blog_domain_semi(hosts, domains, "k").select("k").collect()}
    assert got == {k for k in range(20_000) if k % 3 == 0} | {7}
    assert U.blog_domain_semi(hosts, domains.limit(0), "k").count() == 0


def test_ingest_parses_the_dumps_once(spark, tmp_path):
    dump = str(tmp_path / "dump")
    write_corpus_jsonl(spark, SF01, dump)
    stats = jobs.parse_blogs(spark, dump, str(tmp_path / "raw"), 200, 5000, glob="*.txt")
    # the dumps are in no plan any more: rows and counts come from the written lines
    assert "json" not in stats._jdf.queryExecution().executedPlan().toString().lower()
    whole = stats.filter(F.col("file").isNull()).first()
    assert (whole["lines"], whole["kept"]) == (1000, spark.read.parquet(str(tmp_path / "raw")).count())
    held = spark.read.parquet(str(tmp_path / "raw.lines"))
    assert held.filter("kind = 'bad'").select("line").distinct().count() == table(spark, SF01, "documents").filter("doc_id % 50 = 0").count()
    assert held.filter("kind = 'dropped' AND (text IS NOT NULL OR line IS NOT NULL)").count() == 0
