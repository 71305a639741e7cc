"""License scan, quality, decontamination, personal data and n-gram join against brute force, with edge cases."""

import re
import zlib
from collections import Counter

import numpy as np

from specgrade.llm.decontaminate import contaminated, decontaminate
from specgrade.llm.graph import components
from specgrade.llm.license_scan import license_scan
from specgrade.llm.line_crf import forward_backward, quality
from specgrade.llm.ngram_jaccard import choose_prefix, ngram_components, one_of_each
from specgrade.llm.pii_spans import KINDS, all_spans, base_spans, learn, pii_spans
from specgrade.plans.compare import compare

from .test_exact_line_pack import AZ, EDGES, table

SF001 = "/root/testdata/sf0.001"


def test_license_scan(spark):
    rows = EDGES + [(20, "Released under the MIT-License. mit license"), (21, "x " * 500 + "licensed UNDER the Apache License Version 2.0"),
                    (22, "released under mit Kterms"), (23, "free of charge, any person obtaining a copy of this software: permission is hereby granted to")]
    got = {r.doc_id: r for r in license_scan(table(spark, rows)).collect()}
    assert (got[20].n_words, got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels) == (7, 2, 3, 5, "mit")
    assert (got[21].n_base, got[21].first_word, got[21].labels) == (1, 503, "apache")
    assert (got[23].n_base, got[23].labels, got[23].first_word) == (0, "mit", None)
    assert (got[1].n_words, got[1].score, got[1].labels) == (0, 0.0, "")
    assert license_scan(table(spark, [])).count() == 0


def test_near_miss_notices_get_no_false_label(spark):
    notices = {
        "under the terms of the GNU General Public License": "gpl", "under the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "under the terms of the GNU Affero General Public License": "agpl,gpl", "Licensed under CC BY 4.0": "", "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "released under the Apache license": "apache", "released under the new license of the city": "", "Released under the MIT License": "mit",
        "This work is licensed under a Creative 4.0 International License": "", "All rights reserved, copying of this file is prohibited": "",
        "Permission to use and modify this software for any purpose": "", "free software released into the public domain": "",
        "This Source Code Form is subject to the terms of the Public License": ""}
    got = {r.doc_id: r.labels for r in license_scan(table(spark, list(enumerate(notices)))).collect()}
    assert got == dict(enumerate(notices.values()))


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    n_lines, pairs = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    marginal, moves, log_z = forward_backward(unary, n_lines, pairs)
    at = 0
    for k, n in enumerate(n_lines):
        paths = [[(c >> i) & 1 for i in range(n)] for c in range(2 ** n)]
        w = np.exp([sum(unary[at + i] * y for i, y in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(np.log(w.sum()), log_z[k])
        assert np.allclose((w[:, None] * np.array(paths)).sum(0) / w.sum(), marginal[at:at + n])
        assert np.isclose(moves[k].sum(), n - 1)
        at += n


def test_training_takes_runs_of_adjacent_lines(spark, monkeypatch):
    """Whole documents up to the bound, longer ones by a run of neighbours."""
    from specgrade.llm import line_crf
    seen = {}
    monkeypatch.setattr(line_crf, "train", lambda x, n, q: seen.update(x=x, n=n) or {})
    rows = [(i, "\n".join(f"line {j} of {i} {'x' * j}" for j in range(3 + 40 * (i % 3)))) for i in range(1, 30)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    line_crf.learn(docs, labels, train_lines=20)
    used = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert sorted(seen["n"]) == sorted(min(t.count("\n") + 1, 20) for _, t in used)
    at = 0
    for (i, t), n in zip(used, seen["n"]):
        whole, _, _ = line_crf.line_features([t])
        run = seen["x"][at:at + n]
        at += n
        assert any(np.allclose(run, whole[k:k + n], atol=1e-5) for k in range(len(whole) - n + 1)), i


def test_quality_of_long_texts_and_clashing_columns(spark):
    """A text of a million characters, one of 100,000 lines, columns named
    like the results."""
    from specgrade.llm import line_crf
    docs = spark.createDataFrame([(1, "word " * 200_000, 0.1, 7, True), (2, "a b\n" * 100_000, 0.2, 8, False), (3, None, 0.3, 9, None)],
                                 "doc_id long, text string, score double, predicted int, held_out boolean")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert line_crf.document_scores(["word " * 200_000], line_crf.learn(docs, labels)).shape == (1,)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    edge = quality(table(spark, EDGES), labels.limit(0)).collect()
    assert len(edge) == len(EDGES) and all(r.score == 0.5 and r.predicted == 1 for r in edge)
    assert quality(table(spark, []), labels).count() == 0


def test_decontaminate(spark):
    item = "On Monday the farmer Anna bought 12 kg of apples and sold 7 of them to her neighbour Anna for 3 dollars"
    other = "a train leaves the old station at noon and travels north for several long hours without stopping once"
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (2, other, "x"), (3, None, "x"), (4, "too short", "x")], "item_id long, text string, doc_id string")
    changed = "we read: on Monday the farmer Maria bought 9 kg of apples and sold 1,5 of them to her neighbour Maria for 8 euros yes"
    broken = changed.replace("neighbour Maria", "neighbour Julia")
    rows = [(10, changed), (11, broken), (12, f"before. {other.upper()} after"), (13, "clean text about apples and a train"), (14, None), (15, ""), (12, "none"), (16, f"{other} {other}")]
    docs = table(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(10, 1), (12, 2), (16, 2)}
    assert got[10, 1].reparameterised and not got[12, 2].reparameterised and got[16, 2].containment == 1.0
    assert sorted(r.text or "" for r in decontaminate(docs, bench).collect()) == sorted([broken, "clean text about apples and a train", "", "", "none"])
    assert contaminated(docs, bench, block_windows=5).count() == 3
    assert contaminated(table(spark, []), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    word = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [(r.item_id, word(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in word(r.text)}
    assert want and {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want


def _plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans():
    rng = np.random.default_rng(2)
    parts = list("0123456789.@+- ()a%") + ["a@b.c", "1.2.3.4", "+1 (939) 555-8456", "4398874246221956", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert base_spans(text) == _plain_spans(text), text


def test_pii_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn(docs)
    assert len(pii_spans(table(spark, EDGES), model).collect()) == len(EDGES)
    base, added = all_spans("write to joe.x (at) example (dot) com or +1 (939) 555-8456", model)
    assert [k for k, _, _ in base] == ["phone"] and [k for k, _, _ in added] == ["email"]
    assert all_spans("no data here 12", model) == ([], [])
    assert pii_spans(table(spark, []), learn(table(spark, []))).count() == 0


def _shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _brute(rows, k, num, den):
    sets = [_shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in at[g] if j > i).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                root[find(j)] = find(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), len(sets[i]), str(d if not sets[i] else min(ids, default=None))))
    return sorted(out)


def test_ngram_components(spark):
    rng = np.random.default_rng(4)
    vocab = np.array([f"w{i}" for i in range(400)])
    base = rng.choice(vocab, 120)
    rows = list(EDGES)
    for i in range(90):  # a group whose members differ from the base by few or many words
        t = base.copy()
        at = rng.choice(120, rng.integers(0, 9), replace=False)
        t[at] = rng.choice(vocab, len(at))
        rows.append((100 + i, " ".join(t)))
    rows += [(300 + i, " ".join(rng.choice(vocab, 60))) for i in range(60)] + [(400, "a b"), (401, "A  b"), (402, " \n\t")]
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = ngram_components(table(spark, rows), k=k, num=num, den=den, bits=8, broadcast_rows=5).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _brute(rows, k, num, den)
    left = one_of_each(table(spark, rows), k=4, num=85, den=100, bits=8)
    wordy = [r for r in _brute(rows, 4, 85, 100) if r[1]]
    assert left.columns == table(spark, []).columns
    assert left.filter("trim(coalesce(text, '')) <> '' AND doc_id <> 402").count() == len({c for _, _, c in wordy})
    assert left.filter("doc_id IN (1, 2, 402)").count() == 3
    assert ngram_components(table(spark, [])).count() == 0


def test_prefix_grows_with_cost():
    assert choose_prefix(np.ones(40, dtype=int), 7, 8, 8.0) == 1
    hot = np.concatenate([np.ones(6, dtype=int), np.full(34, 5000)])
    assert choose_prefix(hot, 7, 8, 8.0) >= 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (300, 200), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 300: 100}


def test_components_task_count(spark):
    """The driver keeps a record of every task: a round over few edges must not
    cost many times the shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components_task_count", "")
        got = {r.node: r.label for r in components(edges).collect()}
        told = sc.statusTracker()
        stages = {i for j in told.getJobIdsForGroup("components_task_count") for i in told.getJobInfo(j).stageIds}
        tasks = sum(s.numCompletedTasks for s in map(told.getStageInfo, stages) if s)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(9)}
    assert tasks < 1000


def test_one_of_each_sends_no_bloom_filters(spark, monkeypatch, tmp_path):
    """A runtime Bloom filter is a MB that the driver serialises with every
    later stage of the plan."""
    from specgrade.llm import ngram_jaccard
    plans, cut = [], ngram_jaccard.cut

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out
    monkeypatch.setattr(ngram_jaccard, "cut", seen)
    name = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", name: "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b"}
    before = {k: spark.conf.get(k) for k in held}
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words than those"), (3, "other words than those"), (4, " "), (4, " "), (5, None)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        table(spark, rows).write.parquet(f"{tmp_path}/docs")  # of known size
        left = one_of_each(spark.read.parquet(f"{tmp_path}/docs"), k=4, num=85, den=100, bits=8)
        plans.append(left._jdf.queryExecution().optimizedPlan().toString())
        got = sorted(r.doc_id for r in left.collect())
        assert spark.conf.get(name) == "true"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [1, 3, 4, 4, 5]
    assert not [p for p in plans[-2:] if "might_contain" in p]


def test_queries_match_sql(spark, duck01):
    import __spark_entry__ as entry
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("op1_license_scan", "op5_exact_dedup", "op7_line_dedup"):
        info = compare(queries[name](spark, "/root/testdata/sf0.01"), duck01, sql[name])
        assert info["cols_match"] and info["values_match"], (name, info)


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF001)
        assert kept.columns == docs.columns, name
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in kept.collect()}
        assert set(after) <= set(before) and stage(spark, docs.limit(0), SF001).count() == 0
        if name == "line dedup":
            assert set(after) == set(before)
        else:
            assert all(after[i] == before[i] for i in after)
        docs = kept.checkpoint()
    packed = corpus_pipeline.run(spark, SF001)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_parities_drop_unlike_pairs_and_no_like_one(spark):
    """Of pairs of sets, those whose whole sets are unlike go before any text
    is read again; none that reaches the similarity goes."""
    import numpy as np
    from specgrade.llm import ngram_jaccard as N
    rng = np.random.default_rng(5)
    sim, rows, pairs, like = N.Similarity(4, 85, 100), [], [], set()
    for i in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 500)), dtype=np.uint64))
        keep = x[rng.random(len(x)) < rng.choice([1.0, 0.95, 0.9, 0.5])] if i % 2 else x[:0]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(1, 12)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 85 * (len(x) + len(y) - shared):
            like.add((2 * i, 2 * i + 1))
        rows += [(2 * i + j, len(h), N.parities(h).tolist()) for j, h in enumerate((x, y))]
        pairs.append((2 * i, 2 * i + 1))
    classes = spark.createDataFrame(rows, "node long, n int, odd array<long>")
    got = {tuple(r) for r in N.within(spark.createDataFrame(pairs, "a long, b long"), classes, sim).collect()}
    assert like and like <= got and len(got - like) < 15
