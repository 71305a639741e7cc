"""Matching invariants and partition independence of the pairing operators."""

import random

import pytest
from pyspark.sql import functions as F

from specgrade.operators import pairing as P
from specgrade.operators.corpus import assign_row_number

from conftest import SF01


def seq_greedy(edges):
    used, out = set(), []
    for e in sorted(edges, key=lambda e: (e[0], e[2])):
        i, j, _ = e
        if i not in used and j not in used:
            out.append((i, j))
            used.update((i, j))
    return out


def test_greedy_rounds_equal_sequential(spark):
    rnd = random.Random(3)
    for _ in range(5):
        n = rnd.randint(5, 40)
        edges = {}
        for i in range(n):
            for r in range(rnd.randint(0, 6)):
                j = rnd.randrange(n)
                if j != i:
                    edges.setdefault((i, j), r + 100 * i)
        rows = [(i, j, rk) for (i, j), rk in edges.items()]
        if not rows:
            continue
        df = spark.createDataFrame(rows, "i bigint, j bigint, rank bigint")
        got = sorted((r["i"], r["j"]) for r in P.greedy_matching(df, "i", "j", ["i", "rank"]).collect())
        assert got == sorted(seq_greedy(rows))
        first3 = sorted((r["i"], r["j"]) for r in P.greedy_matching(df, "i", "j", ["i", "rank"], max_pairs=3).collect())
        assert first3 == sorted(seq_greedy(rows)[:3])


def test_candidates_partition_independent(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a = sorted(map(tuple, P.sampled_candidates(e, "vec_id", 50).collect()))
    b = sorted(map(tuple, P.sampled_candidates(e.repartition(7), "vec_id", 50).collect()))
    assert a == b
    # no duplicates, all j > i, at most 50 per i
    assert len(set((i, j) for i, j, _ in a)) == len(a)
    assert all(j > i for i, j, _ in a)


def test_row_number_equals_window(spark):
    c = spark.read.parquet(f"{SF01}/conversations.parquet").repartition(5)
    got = {(r["conv_id"], r["turn"]): r["row_number"] for r in
           assign_row_number(c.select("conv_id", "turn"), ["conv_id", "turn"]).collect()}
    keys = sorted(got)
    assert [got[k] for k in keys] == list(range(1, len(keys) + 1))


@pytest.mark.parametrize("batch", [1 << 17, 23])
def test_knn_matches_bruteforce(spark, batch):
    """One batch (no checkpoint, one corpus pass) and many batches
    (checkpointed vectors, one pass per batch) give the exact top-k."""
    import numpy as np
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = e.collect()[:120]
    small = spark.createDataFrame(rows, e.schema)
    got = {(r["query_id"], r["rank"]): r["id"]
           for r in P.knn(small, small, 3, exclude_self=True, batch=batch).collect()}
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    for qi in range(0, 120, 17):
        order = sorted(range(len(ids)), key=lambda j: (-s[qi, j], ids[j]))[:3]
        assert [got[(ids[qi], r + 1)] for r in range(3)] == [ids[j] for j in order]


def test_sparse_ids_map_to_positions(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    dense = sorted(map(tuple, P.sampled_candidates(e, "vec_id", 20).collect()))
    sparse_e = e.withColumn("vec_id", e["vec_id"] * 7 + 3)
    sparse = sorted(map(tuple, P.sampled_candidates(sparse_e, "vec_id", 20, dense=False).collect()))
    assert sparse == sorted((i * 7 + 3, j * 7 + 3, r) for i, j, r in dense)


def test_running_topk_equals_full_sort():
    """Cutting each block to its top-k and merging with the running best
    keeps the exact top-k by (score desc, id asc), with heavy ties and
    blocks of any size."""
    import numpy as np
    rng = np.random.default_rng(4)
    for _ in range(30):
        m, q, k = int(rng.integers(1, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 8))
        s = rng.integers(0, 4, size=(q, m)).astype(np.float64)  # few distinct values: many ties
        s[rng.random((q, m)) < 0.1] = -np.inf
        ids = rng.permutation(10 * m)[:m].astype(np.int64)
        best_s, best_i = np.empty((q, 0)), np.empty((q, 0), dtype=np.int64)
        start = 0
        while start < m:
            step = int(rng.integers(1, 9))
            blk_s, blk_i = P._top_cols(s[:, start:start + step], ids[start:start + step], k)
            best_s, best_i = P._top_cols(np.hstack([best_s, blk_s]), np.hstack([best_i, blk_i]), k)
            start += step
        for r in range(q):
            want = sorted(((-s[r, c], ids[c]) for c in range(m)))[:k]
            got = sorted(zip(-best_s[r], best_i[r]))
            assert got == want


def test_knn_ties_and_small_batches_equal_bruteforce(spark):
    """A third of the vectors are one and the same; tiny Arrow batches force
    the per-task merge across batches; ties go to the smallest ids."""
    import numpy as np
    rng = np.random.default_rng(9)
    n, d = 90, 6
    m = rng.normal(size=(n, d))
    m[::3] = m[0]
    ids = np.arange(1000, 1000 + n)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["query_id"], r["rank"]): r["id"] for r in P.knn(df, df, 4, exclude_self=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for qi in range(n):
        sc = {int(ids[j]): float(u[qi] @ u[j]) for j in range(n) if j != qi}
        order = sorted(sc, key=lambda j: (-round(sc[j], 9), j))[:4]
        assert [got[(int(ids[qi]), r + 1)] for r in range(4)] == order, qi


@pytest.mark.parametrize("dense", [True, False])
def test_distinct_pairs_prefix_passes_equal_one_pass(spark, dense):
    """The first pairs of the greedy scan found on growing row prefixes
    (bound 1, 4, 16, ...; the first passes restrict the vectors) equal those of a single pass over all rows."""
    from pyspark.sql import functions as F
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    if not dense:
        e = e.withColumn("vec_id", F.col("vec_id") * 7 + 3)  # sparse ids, same order
    kw = dict(lo=0.40, hi=0.50, max_pairs=5, k=50, dense=dense)
    a = sorted(map(tuple, P.find_pairs_distinct(e, first_rows=1, **kw).collect()))
    b = sorted(map(tuple, P.find_pairs_distinct(e, first_rows=1 << 30, **kw).collect()))
    assert a == b and len(a) == 5


@pytest.mark.parametrize("dense,max_pairs", [(True, 4), (False, 4), (True, 40)])
def test_find_pairs_prefix_passes_equal_one_pass(spark, dense, max_pairs):
    """Early stop (4 of the in-band edges) and the exhaustive case (40
    requested, the prefix grows over all rows) both equal one pass."""
    from pyspark.sql import functions as F
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    if not dense:
        e = e.withColumn("vec_id", F.col("vec_id") * 7 + 3)
    kw = dict(lo=0.40, hi=0.50, max_pairs=max_pairs, k=50, dense=dense)
    a = [tuple(r) for r in P.find_pairs(e, first_rows=1, **kw).orderBy("blog_1_id", "blog_2_id").collect()]
    b = [tuple(r) for r in P.find_pairs(e, first_rows=1 << 30, **kw).orderBy("blog_1_id", "blog_2_id").collect()]
    every = P.find_pairs(e, **(kw | {"max_pairs": None})).count()  # as many as the sampler's draws put in the band
    assert a == b and 0 < every and len(a) == min(max_pairs, every)


def test_knn_pairs_batches_and_materialize_agree(spark):
    """Doubling query batches from 4 ids, and checkpointed vectors, give the
    same pairs as the default first batch."""
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    kw = dict(k=10, lo=0.30, hi=0.40, max_pairs=25)
    want = sorted(map(tuple, P.knn_pairs_distinct(e, **kw).collect()))
    assert len(want) == 25
    assert sorted(map(tuple, P.knn_pairs_distinct(e, first_batch=4, **kw).collect())) == want
    assert sorted(map(tuple, P.knn_pairs_distinct(e, materialize=True, **kw).collect())) == want


def test_vectors_for_broadcasts_only_within_the_ceiling(spark):
    """The id list of a prefix is broadcast into a semi join only when its
    bound fits spark.sql.autoBroadcastJoinThreshold; -1 turns it off."""
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    cand = P._prefix_candidates(e, "vec_id", e.count(), 64, 10, 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value, bound, forced in (("4MB", 64 * 11, True), ("-1", 64 * 11, False), ("1kb", 64 * 11, False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            plan = P._vectors_for(cand, e, "vec_id", bound)._jdf.queryExecution().logical().toString()
            assert ("broadcast" in plan.lower()) == forced, (value, plan)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
        assert P.broadcast_limit(spark) == 10485760
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {r["vec_id"] for r in cand.select(F.col("i").alias("vec_id")).union(cand.select("j")).collect()}
    assert {r["vec_id"] for r in P._vectors_for(cand, e, "vec_id", 64 * 11).collect()} == want


def test_restrict_to_keys_in_filter_and_semi_join_agree(spark):
    """A small key list becomes a pushed-down IN filter on the scan; the semi
    join path returns the same rows."""
    import io
    from contextlib import redirect_stdout

    from specgrade.operators.joins import restrict_to_keys
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    keys = spark.createDataFrame([(5,), (17,), (999999,)], "doc_id long")
    a = restrict_to_keys(docs, "doc_id", keys, 3)
    buf = io.StringIO()
    with redirect_stdout(buf):
        a.explain("formatted")
    assert "In(doc_id" in buf.getvalue()
    b = restrict_to_keys(docs, "doc_id", keys, 3, read_keys=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r["doc_id"] for r in a.collect()) == [5, 17]


def test_scorer_duplicates_tie_by_id_at_block_scale():
    """A third of the corpus is one repeated vector, spread over a large block
    (BLAS tiles and edge tiles): every query's neighbours equal a brute force
    in which copies tie exactly, so they come in id order."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(21)
    n, d, k = 900, 48, 7
    m = rng.normal(size=(n, d))
    m[rng.permutation(n)[: n // 3]] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    qsel = rng.permutation(n)[:150]
    pdf = pd.DataFrame({"_id": ids, "_v": list(m)})
    out = pd.concat(list(P._topk_scorer(ids[qsel], m[qsel], k, True)([pdf.iloc[:400], pdf.iloc[400:]])))
    # brute force: one score per distinct vector, so copies tie exactly
    uniq, inv = np.unique(m, axis=0, return_inverse=True)
    inv = inv.reshape(-1)
    for qi in qsel:
        su = (uniq.astype(np.longdouble) @ m[qi].astype(np.longdouble)).astype(np.float64)
        cand = [(-su[inv[j]], ids[j]) for j in range(n) if j != qi]
        want = [i for _, i in sorted(cand)[:k]]
        got = out[out["query_id"] == ids[qi]].sort_values(["score", "id"], ascending=[False, True])["id"].tolist()
        assert got[:k] == want, int(ids[qi])


def test_sampler_takes_exactly_min_k_m(spark):
    n = 3000
    ids = spark.range(n).select(F.col("id").alias("vec_id"))
    rows = P.sampled_candidates(ids, "vec_id", 50, seed=3).groupBy("i").agg(
        F.count("j").alias("c"), F.count_distinct("j").alias("d"), F.min("j").alias("lo"), F.max("j").alias("hi"),
        F.max("rank").alias("r")).collect()
    assert len(rows) == n - 1
    for r in rows:
        assert r.c == r.d == r.r == min(50, n - 1 - r.i) and r.i < r.lo and r.hi < n


def test_sampler_reaches_beyond_31_bits(spark):
    n = 6 * 10 ** 9
    got = spark.range(200).select("id", F.explode(P.candidate_ids("id", F.lit(n), 50)).alias("j"))
    r = got.agg(F.max("j").alias("hi"), F.min("j").alias("lo"), F.count_distinct("id", "j").alias("d"),
                F.count_if(F.col("j") > n // 2).alias("upper")).first()
    assert r.d == 200 * 50 and 200 * 20 < r.upper < 200 * 30
    assert n - n // 50 < r.hi < n and r.lo > 0


def test_cell_search_equals_brute_force_at_any_partitioning(spark):
    """A third of the vectors are equal; cells, blocks and slices are small."""
    import numpy as np
    rng = np.random.default_rng(8)
    m = rng.integers(-4, 5, size=(240, 6)).astype(float)  # integers: scores are exact
    m[rng.permutation(240)[:80]] = m[0]
    ids = rng.permutation(5000)[:240]
    want = []
    for a in range(240):
        s = m @ m[a]
        order = sorted((-s[b], int(ids[b])) for b in range(240) if b != a)[:5]
        want += [(int(ids[a]), i, -x, r + 1) for r, (x, i) in enumerate(order)]
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "_id long, _v array<double>")
    for parts in (1, 8, 64):
        c = e.repartition(parts)
        got = P.knn_prepared(c, c, 5, exclude_self=True, batch=10, cells=7, block=16)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), parts
    few = P.knn_prepared(e, e.limit(3), 5, batch=10, cells=7, block=16)
    assert few.count() == 240 * 3


def test_cell_search_copies_repeated_ids_and_missing_numbers(spark):
    """Half of the vectors are equal, some ids come twice, one vector holds a
    NaN: the tiles give what brute force gives, and the vectors of a search
    from float32 input are those of unit length."""
    import numpy as np
    rng = np.random.default_rng(11)
    m = rng.integers(-3, 4, size=(300, 5)).astype(float)
    m[::2], m[7] = m[1], [np.nan, 1, 1, 1, 1]
    ids = np.concatenate([np.arange(280), np.arange(20)])
    want = {}
    for a in range(300):
        s = m @ m[a]
        order = [(-s[b], int(ids[b])) for b in range(300) if ids[b] != ids[a] and np.isfinite(s[b])]
        want.setdefault(int(ids[a]), []).extend(order)
    want = sorted((a, i, -x, r + 1) for a, order in want.items() for r, (x, i) in enumerate(sorted(order)[:4]))
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "_id long, _v array<double>").repartition(5)
    got = P.knn_prepared(e, e, 4, exclude_self=True, batch=10, cells=6, block=16)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_routed_query_is_no_row_for_each_block(spark, monkeypatch):
    """Nothing written on the way holds a query's vector once for each block."""
    import numpy as np
    rng = np.random.default_rng(12)
    m = rng.normal(size=(600, 4))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "_id long, _v array<double>")
    written, plain = [], type(e).checkpoint

    def spy(df, *args):
        out = plain(df, *args)
        written.append(out.count())
        return out
    monkeypatch.setattr(type(e), "checkpoint", spy)
    assert P.knn_prepared(e, e, 3, exclude_self=True, batch=10, cells=60, block=8).count() == 1800
    assert written and max(written) <= 600


def test_normalising_is_linear_in_the_dimension(spark):
    """The norm is summed once for a vector, not once for each element."""
    import time
    from pyspark.sql import functions as F
    df = spark.range(0, 16, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda x: (x + F.col("id")).cast("double")).alias("v")).cache()
    assert df.count() == 16
    began = time.time()
    got = df.select(P.vector_norm(P.l2_normalize("v")).alias("n")).agg(F.max("n"), F.min("n")).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 1) < 1e-9
    assert time.time() - began < 5
    empty = spark.createDataFrame([(None,), ([0.0, 0.0],), ([],)], "v array<double>").select(P.l2_normalize("v").alias("u")).collect()
    assert [r["u"] for r in empty] == [None, None, None]


def test_no_vector_is_shuffled_once_for_each_tile(spark):
    """F3 of FINDINGS_r04.md: where no tile can be ruled out, tiles meet by
    being read again, and the plan has no shuffle of slices and tiles."""
    import numpy as np
    m = np.random.default_rng(13).integers(-9, 10, size=(400, 6)).astype(float)  # integers: scores are exact
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "_id long, _v array<double>")
    got = P.knn_prepared(e, e, 3, exclude_self=True, batch=10, cells=20, block=8)
    s = m @ m.T
    want = [(a, b, s[a, b], r + 1) for a in range(400) for r, b in enumerate(sorted((b for b in range(400) if b != a), key=lambda b: (-s[a, b], b))[:3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
