"""Findings of FINDINGS_r04.md: each test failed before its finding was settled."""

from specgrade.llm import decontaminate as D

from .test_exact_line_pack import table


def test_windows_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """with more windows than may be broadcast, the documents are
    still read once, and no broadcast holds the windows' words."""
    items = [f"{a} met Anna and {n} friends at the {b} house where they ate {n} {c} cakes and drank cold tea all day"
             for n, (a, b, c) in enumerate([("tom", "old", "red"), ("lea", "new", "blue"), ("max", "big", "green")])]
    rows = [(i, "well " + t.replace("Anna", "Maria") + " yes") for i, t in enumerate(items)] + [(9, "nothing here"), (10, None)]
    docs = table(spark, rows)
    bench = spark.createDataFrame([*enumerate(items), (7, items[0]), (8, "")], "item_id long, text string")
    kept = []
    monkeypatch.setattr(D, "cut", lambda df, cut=D.cut: kept.append(df) or cut(df))
    want = {(0, 0), (0, 7), (1, 1), (2, 2)}
    few = sorted(tuple(r) for r in D.contaminated(docs, bench).collect())
    assert {(r[0], r[1]) for r in few} == want
    kept.clear()
    many = sorted(tuple(r) for r in D.contaminated(docs, bench, block_windows=5).collect())
    assert many == few
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in kept]
    hits = [p.split("== Initial Plan ==")[1] for p in plans if "slots" in p]  # before Spark knows that the tables are tiny
    assert len(hits) == 1 and hits[0].count("BroadcastExchange") == 1 and "SortMergeJoin" in hits[0]
    assert len(D.decontaminate(docs, bench, block_windows=5).collect()) == 2


def test_items_with_equal_texts_are_searched_once(spark):
    bench = spark.createDataFrame([(i, "the same words stand in all of these many items") for i in range(50)] + [(50, "another")], "item_id long, text string")
    named, items = D.named_items(bench)
    assert named.count() == 51 and items.count() == 2
    assert D.contaminated(table(spark, [(1, "so the same words stand in all of these many items")]), bench).count() == 50
