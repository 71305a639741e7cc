"""Registered queries for embedding similarity, sampling, matching and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrade.functions.hashing import mix62_sql
from specgrade.operators import ann as A
from specgrade.operators import joins as J
from specgrade.operators import pairing as P
from specgrade.plans.registry import query
from specgrade.plans.tables import table

K = P.DEFAULT_K

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("l2_norm", f"SELECT vec_id, {_NORM} AS norm FROM embeddings", round_cols=('norm',))
def l2_norm(spark, sf):
    """Vector norms (the normaliser's denominator)."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", P.vector_norm("embedding").alias("norm"))


CANDIDATES_SQL = f"""
  (WITH nn AS (SELECT count(*) AS n FROM embeddings),
   ids AS (SELECT vec_id AS i, n - 1 - vec_id AS m FROM embeddings, nn),
   strata AS (SELECT i, {mix62_sql('i', 'r')} AS h, (r * m) // {K} AS lo, ((r + 1) * m) // {K} - (r * m) // {K} AS width
              FROM ids, LATERAL (SELECT unnest(generate_series(0, {K - 1})) AS r) WHERE m > 0),
   draws AS (SELECT i, i + 1 + lo + h % width AS j, h FROM strata WHERE width > 0)
   SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY h, j) AS rank FROM draws)
"""

SCORED_SQL = f"""
  (SELECT c.i, c.j, c.rank,
          list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
   FROM {CANDIDATES_SQL} c JOIN embeddings a ON a.vec_id = c.i JOIN embeddings b ON b.vec_id = c.j)
"""


@query("sampled_candidates", f"SELECT i, j, CAST(rank AS INTEGER) AS rank FROM {CANDIDATES_SQL}")
def sampled_candidates(spark, sf):
    """P5: <= 50 seeded candidates j > i per row, in scan order."""
    return P.sampled_candidates(table(spark, sf, "embeddings"), "vec_id", K).withColumn(
        "rank", F.col("rank").cast("int"))


@query("candidate_cosine", f"SELECT i, j, similarity FROM {SCORED_SQL}", round_cols=('similarity',))
def candidate_cosine(spark, sf):
    """P3 on the sampled candidate edges (cosine of normalised vectors)."""
    e = table(spark, sf, "embeddings")
    return P.score_edges(P.sampled_candidates(e, "vec_id", K), e).select("i", "j", "similarity")


@query("band_pairs", f"SELECT i, j, similarity FROM {SCORED_SQL} WHERE similarity BETWEEN 0.40 AND 0.50", round_cols=('similarity',))
def band_pairs(spark, sf):
    """Candidate edges with cosine in [0.40, 0.50]."""
    e = table(spark, sf, "embeddings")
    return P.band_pairs(P.score_edges(P.sampled_candidates(e, "vec_id", K), e), 0.40, 0.50).select(
        "i", "j", "similarity")


@query("find_pairs", f"""
SELECT i AS blog_1_id, j AS blog_2_id, similarity FROM {SCORED_SQL}
WHERE similarity BETWEEN 0.40 AND 0.50 ORDER BY i, rank LIMIT 25
""", round_cols=('similarity',))
def find_pairs(spark, sf):
    """First 25 in-band candidates in scan order (pairs may share rows)."""
    return P.find_pairs(table(spark, sf, "embeddings"), 0.40, 0.50, 25, K)


@query("find_pairs_all", f"""
SELECT i AS blog_1_id, j AS blog_2_id, similarity FROM {SCORED_SQL} WHERE similarity BETWEEN 0.20 AND 0.50
""", round_cols=('similarity',))
def find_pairs_all(spark, sf):
    """P6 without a limit: every in-band candidate."""
    return P.find_pairs(table(spark, sf, "embeddings"), 0.20, 0.50, None, K)


def greedy_sql(edges_sql: str, limit: int | None) -> str:
    """Sequential greedy matching as a recursive walk over priority-numbered edges."""
    lim = f"LIMIT {limit}" if limit else ""
    stop = f"WHERE len(w.used) < {2 * limit}" if limit else ""
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i, rank) AS n, i, j, similarity FROM {edges_sql}),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pi,
         CAST(NULL AS BIGINT) AS pj, CAST(NULL AS DOUBLE) AS ps
  UNION ALL
  SELECT e.n,
         CASE WHEN list_contains(w.used, e.i) OR list_contains(w.used, e.j) THEN w.used
              ELSE list_concat(w.used, [e.i, e.j]) END,
         CASE WHEN list_contains(w.used, e.i) OR list_contains(w.used, e.j) THEN NULL ELSE e.i END,
         CASE WHEN list_contains(w.used, e.i) OR list_contains(w.used, e.j) THEN NULL ELSE e.j END,
         CASE WHEN list_contains(w.used, e.i) OR list_contains(w.used, e.j) THEN NULL ELSE e.similarity END
  FROM walk w JOIN e ON e.n = w.n + 1
  {stop})
SELECT pi AS blog_1_id, pj AS blog_2_id, round(ps, 3) AS similarity FROM walk WHERE pi IS NOT NULL
ORDER BY n {lim}
"""


_DISTINCT = greedy_sql(f"(SELECT * FROM {SCORED_SQL} WHERE similarity BETWEEN 0.40 AND 0.50)", 25)


@query("distinct_pairs", f"""
SELECT p.blog_1_id, p.blog_2_id, p.similarity, d1.text AS blog_1_text, d2.text AS blog_2_text
FROM ({_DISTINCT}) p LEFT JOIN documents d1 ON d1.doc_id = p.blog_1_id LEFT JOIN documents d2 ON d2.doc_id = p.blog_2_id
""")
def distinct_pairs(spark, sf):
    """P7+P8+P13: 25 disjoint in-band pairs by greedy matching, texts attached."""
    e = table(spark, sf, "embeddings")
    pairs = P.find_pairs_distinct(e, 0.40, 0.50, 25, K)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return P.attach_pair_text(pairs, docs, "doc_id", max_pairs=25)


@query("distinct_pairs_all", greedy_sql(f"(SELECT * FROM {SCORED_SQL} WHERE similarity BETWEEN 0.40 AND 0.50)", None))
def distinct_pairs_all(spark, sf):
    """P8 without a pair limit: the complete greedy matching of in-band edges."""
    e = table(spark, sf, "embeddings")
    return P.find_pairs_distinct(e, 0.40, 0.50, None, K)


@query("distinct_pairs_wide", greedy_sql(f"(SELECT * FROM {SCORED_SQL} WHERE similarity BETWEEN 0.05 AND 0.50)", 25))
def distinct_pairs_wide(spark, sf):
    """P7 over a wide band, where edges conflict and the limit binds, in
    growing prefixes of 8, 32, ... rows."""
    return P.find_pairs_distinct(table(spark, sf, "embeddings"), 0.05, 0.50, 25, K, first_rows=8)


@query("pair_stats", f"""
SELECT count(*) AS n_pairs, min(similarity) AS min_similarity, max(similarity) AS max_similarity,
       avg(similarity) AS mean_similarity FROM ({_DISTINCT})
""", round_cols=('mean_similarity',))
def pair_stats(spark, sf):
    """Statistics of the distinct pairs."""
    return P.pair_stats(P.find_pairs_distinct(table(spark, sf, "embeddings"), 0.40, 0.50, 25, K))


@query("pair_stats_all", f"""
SELECT count(*) AS n_pairs, min(similarity) AS min_similarity, max(similarity) AS max_similarity,
       avg(similarity) AS mean_similarity FROM {SCORED_SQL} WHERE similarity BETWEEN 0.20 AND 0.50
""", round_cols=('min_similarity', 'max_similarity', 'mean_similarity'))
def pair_stats_all(spark, sf):
    """P12 over every in-band candidate."""
    return P.pair_stats(P.find_pairs(table(spark, sf, "embeddings"), 0.20, 0.50, None, K))


_ALLSCORES = """
  (SELECT a.vec_id AS query_id, b.vec_id AS id,
          list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
"""


@query("knn_top10", f"""
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_ALLSCORES})
WHERE rank <= 10
""", round_cols=('score',))
def knn_top10(spark, sf):
    """Exact 10 nearest neighbours (self excluded) of every vector."""
    e = table(spark, sf, "embeddings")
    return P.knn(e, e, 10, exclude_self=True)


@query("knn_cells", f"""
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_ALLSCORES})
WHERE rank <= 3
""", round_cols=('score',))
def knn_cells(spark, sf):
    """P9 by the path of more queries than one batch holds: cells and blocks."""
    e = table(spark, sf, "embeddings")
    v = P.prepare_vectors(e)
    return P.knn_prepared(v, v, 3, exclude_self=True, batch=1, cells=16, block=128)


LSH = {"tables": 8, "bucket_rows": 64, "flips": 2, "seed": 0}


def _lsh_sql(n_rows: int, dim: int, k: int = 10) -> str:
    """The same codes, probes and exact scores; the planes are literals."""
    bits = A.code_bits(n_rows, LSH["bucket_rows"])
    planes = A.hyperplanes(dim, LSH["tables"], bits, LSH["seed"]).astype(int)
    rows = ", ".join(f"({t}, {b}, {planes[t, b].tolist()})" for t in range(LSH["tables"]) for b in range(bits))
    masks = " UNION ALL ".join(f"SELECT {m}" for m in ("0", "m1", "m2", "m1 + m2"))
    return f"""
WITH p(t, b, s) AS (VALUES {rows}),
a AS (SELECT vec_id, t, b, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(s AS DOUBLE[])) AS x FROM embeddings CROSS JOIN p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(x), b) AS unsure FROM a),
c AS (SELECT vec_id, t, sum(CASE WHEN x > 0 THEN 1 << b ELSE 0 END) AS code,
             sum(CASE WHEN unsure = 1 THEN 1 << b ELSE 0 END) AS m1, sum(CASE WHEN unsure = 2 THEN 1 << b ELSE 0 END) AS m2
      FROM r GROUP BY vec_id, t),
q AS (SELECT vec_id, t, xor(CAST(code AS BIGINT), CAST(m AS BIGINT)) AS code FROM c, LATERAL ({masks}) x(m)),
pairs AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS id FROM q JOIN c ON q.t = c.t AND q.code = c.code AND q.vec_id <> c.vec_id),
scored AS (SELECT query_id, id, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score
           FROM pairs JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = id)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k}
"""


# the planes' number follows the rows: the SQL is that of sf0.01 (500 vectors of 64)
@query("knn_lsh", _lsh_sql(500, 64), round_cols=("score",))
def knn_lsh(spark, sf):
    """P9, approximate: 10 neighbours of every vector from hashed buckets."""
    e = table(spark, sf, "embeddings")
    return A.knn_lsh(e, e, 10, exclude_self=True, **LSH)


@query("semantic_search", """
SELECT id, round(score, 3) AS score, substr(d.text, 1, 200) AS preview FROM (
  SELECT b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id = 7) s
LEFT JOIN documents d ON d.doc_id = s.id
ORDER BY score DESC, id LIMIT 5
""")
def semantic_search(spark, sf):
    """P10: top-5 hits for the vector of item 7, 3-dp score, 200-char preview."""
    e = table(spark, sf, "embeddings")
    hits = P.knn(e.filter(F.col("vec_id") == 7), e, 5).checkpoint()  # 5 rows
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = J.restrict_to_keys(docs, "id", hits.select("id"), 5)  # pushed-down IN: no full text scan
    return hits.join(docs, "id", "left").select(
        "id", F.round("score", 3).alias("score"), F.substring("text", 1, 200).alias("preview"))


_KNN_EDGES = f"""
  (SELECT query_id AS i, id AS j, rank, score AS similarity FROM (
     SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_ALLSCORES})
   WHERE rank <= 9 AND score BETWEEN 0.30 AND 0.40)
"""


@query("knn_pairs", greedy_sql(_KNN_EDGES, 25))
def knn_pairs(spark, sf):
    """Top-10 search per row (self dropped), 0.30-0.40 band, 25 disjoint pairs."""
    return P.knn_pairs_distinct(table(spark, sf, "embeddings"), k=10, lo=0.30, hi=0.40, max_pairs=25)


@query("knn_pairs_all", greedy_sql(_KNN_EDGES, None))
def knn_pairs_all(spark, sf):
    """P11 without a limit: the whole matching of in-band neighbours."""
    return P.knn_pairs_distinct(table(spark, sf, "embeddings"), k=10, lo=0.30, hi=0.40, max_pairs=None)
