"""Approximate search against the exact one, and search by text with a stored
feature pipeline."""

import numpy as np
from pyspark.sql import functions as F

from specgrade.operators import ann as A
from specgrade.operators import features as FE
from specgrade.operators import pairing as P
from specgrade.plans.catalog import QUERIES
from specgrade.plans.pairing_plans import _lsh_sql
from specgrade.plans.compare import compare, duck_connection

from conftest import SF01


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def test_lsh_recall_on_the_table(spark):
    """All vectors of the table are random directions, the hardest case."""
    got = A.recall(QUERIES["knn_lsh"](spark, SF01), QUERIES["knn_top10"](spark, SF01)).first()
    assert got["n_truth"] == 5000 and got["recall"] >= 0.9


def test_lsh_recall_and_pruning_on_clusters(spark):
    """Vectors in clusters: over 0.9 found while few pairs are scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    m = np.repeat(centres, 40, axis=0) + 0.15 * rng.normal(size=(2400, 32))
    df = vectors(spark, m)
    index = A.build_lsh(df, tables=6, bucket_rows=64)
    assert index.bits == 6 and index.rows.count() == 6 * 2400
    found = A.search_lsh(index, df, 10, flips=1, exclude_self=True)
    assert A.recall(found, P.knn(df, df, 10, exclude_self=True)).first()["recall"] >= 0.9
    probes = A._codes(P.prepare_vectors(df), index.planes(), 1)
    scored = probes.groupBy("bucket").count().join(index.rows.groupBy("bucket").count().withColumnRenamed("count", "held"), "bucket").agg(F.sum(F.col("count") * F.col("held"))).first()[0]
    assert scored < 0.6 * 2400 * 2400


def test_lsh_hot_bucket_is_cut_and_exact_scores(spark):
    """A third of all vectors equal: blocks and slices, no neighbour twice,
    scores are exact inner products, ties by id."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[::3] = m[0]
    df = vectors(spark, m)
    got = A.search_lsh(A.build_lsh(df, tables=4, bucket_rows=16), df, 5, flips=2, exclude_self=True, block=20).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert len({(r.query_id, r.id) for r in got}) == len(got)
    assert all(abs(r.score - u[r.query_id] @ u[r.id]) < 1e-12 for r in got)
    copies = [i for i in range(0, 300, 3)]
    for q in (0, 150, 297):
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [c for c in copies if c != q][:5]


def test_lsh_index_is_stored_and_odd_rows_are_left_out(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    A.build_lsh(df, tables=3, bucket_rows=1).save(str(tmp_path))
    index = A.LshIndex.load(spark, str(tmp_path))
    assert (index.n, index.dim, index.tables) == (3, 2, 3)
    got = A.search_lsh(index, df.filter("vec_id = 1"), 1, exclude_self=True).first()
    assert (got.query_id, got.id, got.rank) == (1, 2, 1)
    assert A.knn_lsh(df.limit(0), df, 3).count() == 0 and A.knn_lsh(df, df.limit(0), 3).count() == 0


def test_lsh_sql_follows_the_rows(spark):
    """The SQL's planes fit the number of vectors at sf0.01, and at another size by parameter."""
    n = spark.read.parquet(f"{SF01}/embeddings.parquet").count()
    sf = SF01.replace("sf0.01", "sf0.001")
    m = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert n == 500
    info = compare(QUERIES["knn_lsh"](spark, sf).withColumn("score", F.round("score", 9)), duck_connection(sf),
                   f"SELECT * REPLACE (round(score, 9) AS score) FROM ({_lsh_sql(m, 64)})")
    assert info["values_match"], info


def test_text_search_uses_the_corpus_weights(spark, tmp_path):
    docs = spark.createDataFrame([(1, "common common rare"), (2, "common word here"), (3, "Привет мир общий"), (4, "你好 世界"), (5, None), (6, "...")],
                                 "doc_id long, text string")
    FE.save_embedder(FE.fit_embedder(docs, "text", 1 << 12), str(tmp_path / "model"))
    model = FE.load_embedder(str(tmp_path / "model"))
    asks = spark.createDataFrame([(10, "rare"), (11, "мир"), (12, "世界"), (13, ""), (14, None), (15, "unseen")], "query_id long, text string")
    got = P.search_text(asks, docs, model, 1).collect()
    assert {(r.query_id, r.id) for r in got if r.score > 0} == {(10, 1), (11, 3), (12, 4)}
    # the stored weights, not those of the queries
    one = FE.embed(model, asks.filter("query_id = 10")).first()["embedding"]
    assert one == FE.embed(FE.fit_embedder(docs, "text", 1 << 12), asks.filter("query_id = 10")).first()["embedding"]
    alike = P.search_text(asks, docs, model, 1, search=lambda q, c, k, normalize: A.knn_lsh(q, c, k, bucket_rows=1000, normalize=normalize))
    assert {(r.query_id, r.id) for r in alike.collect() if r.score > 0} == {(10, 1), (11, 3), (12, 4)}
