"""Registered queries for the remaining inventory rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specgrade.functions import text as T
from specgrade.operators import corpus as C
from specgrade.operators import features as FE
from specgrade.operators import lists as OL
from specgrade.operators import pairing as P
from specgrade.operators import stages as SG
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import WS
from specgrade.plans.tables import constraints_text, satisfaction_text, table
from specgrade.session import ensure_checkpoint_dir
from specgrade.sources.manifest import output_name


@query("output_name", """
SELECT page_id, name,
  CASE WHEN NOT (ends_with(name, '.zst') OR ends_with(name, '.gz')) THEN NULL
       WHEN ends_with(name, '.jsonl.zst') THEN substr(name, 1, length(name) - 10) || '.json.jsonl'
       WHEN ends_with(name, '.jsonl.gz') THEN substr(name, 1, length(name) - 9) || '.json.jsonl'
       WHEN ends_with(name, '.json.zst') THEN substr(name, 1, length(name) - 9) || '.json.jsonl'
       WHEN ends_with(name, '.json.gz') THEN substr(name, 1, length(name) - 8) || '.json.jsonl'
       ELSE regexp_replace(name, '\\.[^.]*$', '') || '.jsonl' END AS output_name
FROM (SELECT page_id, 'dump-' || CAST(page_id AS VARCHAR) ||
        CASE page_id % 6 WHEN 0 THEN '.jsonl.gz' WHEN 1 THEN '.json.zst' WHEN 2 THEN '.jsonl.zst'
                         WHEN 3 THEN '.json.gz' WHEN 4 THEN '.txt.gz' ELSE '.parquet' END AS name FROM pages)
""")
def output_name_q(spark, sf):
    """Output file names for dump files named after each page."""
    p = table(spark, sf, "pages").select("page_id")
    suffix = (F.when(F.col("page_id") % 6 == 0, ".jsonl.gz").when(F.col("page_id") % 6 == 1, ".json.zst")
              .when(F.col("page_id") % 6 == 2, ".jsonl.zst").when(F.col("page_id") % 6 == 3, ".json.gz")
              .when(F.col("page_id") % 6 == 4, ".txt.gz").otherwise(".parquet"))
    p = p.withColumn("name", F.concat(F.lit("dump-"), F.col("page_id").cast("string"), suffix))
    return p.withColumn("output_name", output_name("name"))


@query("rename_for_eval", """
SELECT doc_id AS "Instruction Number", lang AS "Main Task", text AS base_blog FROM documents
""")
def rename_for_eval(spark, sf):
    """Stage columns renamed to the notebook names."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("instruction_number"),
                                             F.col("lang").alias("main_task"), F.col("text").alias("base_content"))
    return SG.to_legacy_names(C.rename_columns(d, {}))


@query("length_compliance", f"""
SELECT doc_id, CAST(w AS BIGINT) AS word_count, w > 400 AS over_base_limit, w > 500 AS over_fitted_limit
FROM (SELECT doc_id, CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE len(string_split_regex(trim(text, {WS}), '\\s+')) END AS w
      FROM documents)
""")
def length_compliance(spark, sf):
    """Word-count limits stated for base (~400) and fitted (<= 500) texts."""
    d = table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("word_count"))
    return d.withColumns({"over_base_limit": F.col("word_count") > 400, "over_fitted_limit": F.col("word_count") > 500})


def _check_replacement_sql():
    from specgrade.plans.score_plans import _ROW_RE
    from specgrade.plans.sqlparts import CONSTRAINTS_TEXT, SATISFACTION_TEXT, parse_numbered_sql
    items = parse_numbered_sql("constraints")
    return f"""
WITH o AS (
  SELECT instruction_number, CAST(i AS BIGINT) AS idx, items[i] AS c0
  FROM (SELECT instruction_number, {items} AS items FROM {CONSTRAINTS_TEXT}) t,
       LATERAL (SELECT unnest(generate_series(1, len(items))) AS i)),
v AS (
  SELECT instruction_number, CAST(n[i] AS BIGINT) AS idx, vv[i] AS verdict
  FROM (SELECT instruction_number, regexp_extract_all(satisfaction_results, {_ROW_RE}, 1) AS n,
               regexp_extract_all(satisfaction_results, {_ROW_RE}, 2) AS vv FROM {SATISFACTION_TEXT}) t,
       LATERAL (SELECT unnest(generate_series(1, len(n))) AS i)),
ov AS (SELECT o.instruction_number, o.idx, o.c0, v.verdict FROM o
       LEFT JOIN v ON v.instruction_number = o.instruction_number AND v.idx = o.idx),
rv AS (SELECT instruction_number, CASE WHEN verdict = 'Yes' THEN 'new: ' || c0 ELSE c0 END AS c FROM ov),
rset AS (SELECT DISTINCT instruction_number, trim(c) AS c FROM rv),
per AS (SELECT ov.instruction_number,
               count(*) FILTER (WHERE ov.verdict = 'No' AND r.c IS NULL) AS no_missing,
               count(*) FILTER (WHERE ov.verdict = 'Yes' AND r.c IS NOT NULL) AS yes_remaining,
               count(*) AS n_original
        FROM ov LEFT JOIN rset r ON r.instruction_number = ov.instruction_number AND r.c = trim(ov.c0)
        GROUP BY ov.instruction_number),
nr AS (SELECT instruction_number, count(*) AS n_revised FROM rv GROUP BY instruction_number)
SELECT per.instruction_number, no_missing, yes_remaining, n_original, nr.n_revised,
       (no_missing = 0 AND yes_remaining = 0 AND coalesce(nr.n_revised, 0) = n_original) AS ok
FROM per LEFT JOIN nr ON nr.instruction_number = per.instruction_number
"""


@query("check_replacement", _check_replacement_sql())
def check_replacement(spark, sf):
    """A revision that keeps every 'No' constraint and replaces every
    'Yes' one (derived: each Yes item is rewritten) must pass the checks."""
    c = constraints_text(spark, sf).select("instruction_number", "constraints")
    s = satisfaction_text(spark, sf).select("instruction_number", "satisfaction_results")
    orig = OL.explode_constraints(c, "instruction_number")
    from specgrade.functions import scoring as S
    ver = s.select("instruction_number", F.explode(S.verdict_rows("satisfaction_results")).alias("v")).select(
        "instruction_number", "v.idx", "v.verdict")
    revised = (orig.join(ver, ["instruction_number", "idx"], "left")
                   .withColumn("constraint", F.when(F.col("verdict") == "Yes",
                                                    F.concat(F.lit("new: "), F.col("constraint")))
                               .otherwise(F.col("constraint"))))
    return SG.check_replacement(orig, revised.select("instruction_number", "constraint"), ver)


def _embed_knn_sql(dim: int = 256, k: int = 5) -> str:
    """Hashed TF-IDF (idf = ln((m + 1) / (df + 1)) over all m documents),
    L2-normalised (a zero vector stays zero), exact top-k by inner product."""
    from specgrade.plans.sqlparts import hashed_tokens_sql
    return f"""
WITH tok AS (SELECT * FROM {hashed_tokens_sql("documents", "doc_id", "text", dim)}),
tf AS (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY doc_id, bucket),
df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
w AS (SELECT tf.doc_id, tf.bucket, tf.tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df.df + 1.0)) AS w
      FROM tf JOIN df ON df.bucket = tf.bucket),
sp AS (SELECT d.doc_id, coalesce(list(struct_pack(b := w.bucket, w := w.w)) FILTER (WHERE w.bucket IS NOT NULL), []) AS e
       FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id),
dense AS (SELECT doc_id, list_transform(range(0, {dim}),
                   lambda i: coalesce(list_extract(list_filter(e, lambda p: p.b = i), 1).w, 0.0)) AS v FROM sp),
nrm AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM dense),
vec AS (SELECT doc_id, CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda x: x / n) END AS v FROM nrm),
sc AS (SELECT a.doc_id AS query_id, b.doc_id AS id, list_dot_product(a.v, b.v) AS score
       FROM vec a JOIN vec b ON a.doc_id <> b.doc_id)
SELECT query_id, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc)
WHERE rank <= {k}
"""


@query("embed_knn", _embed_knn_sql(), round_cols=("score",))
def embed_knn(spark, sf):
    """P1+P9: hashed TF-IDF embeddings of the documents, 5 nearest per document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    emb = FE.embed_text(d, "text", 256)
    return P.knn(emb, emb, 5, "vec_id", "embedding", exclude_self=True, normalize=False)


def _search_text_sql(dim: int = 256, k: int = 5) -> str:
    """The documents' hashed TF-IDF, and the queries' with the documents' IDF."""
    from specgrade.plans.sqlparts import hashed_tokens_sql
    return f"""
WITH m AS (SELECT count(*) AS n FROM documents),
dtf AS (SELECT doc_id AS k, bucket, CAST(count(*) AS DOUBLE) AS tf FROM {hashed_tokens_sql("documents", "doc_id", "text", dim)} GROUP BY ALL),
idf AS (SELECT b AS bucket, ln(((SELECT n FROM m) + 1.0) / (count(dtf.k) + 1.0)) AS idf FROM range({dim}) t(b) LEFT JOIN dtf ON dtf.bucket = b GROUP BY b),
qtf AS (SELECT item_id AS k, bucket, CAST(count(*) AS DOUBLE) AS tf FROM {hashed_tokens_sql("benchmark", "item_id", "text", dim)} GROUP BY ALL),
d AS (SELECT k, bucket, tf * idf AS w FROM dtf JOIN idf USING (bucket)),
q AS (SELECT k, bucket, tf * idf AS w FROM qtf JOIN idf USING (bucket)),
dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM d GROUP BY k),
qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM q GROUP BY k),
hits AS (SELECT q.k AS query_id, d.k AS id, sum(d.w / dn.n * (q.w / qn.n)) AS score
         FROM q JOIN d ON d.bucket = q.bucket JOIN qn ON qn.k = q.k JOIN dn ON dn.k = d.k WHERE qn.n > 0 AND dn.n > 0 GROUP BY ALL),
every AS (SELECT qn.k AS query_id, dn.k AS id, coalesce(score, 0.0) AS score FROM qn CROSS JOIN dn LEFT JOIN hits ON hits.query_id = qn.k AND hits.id = dn.k
          WHERE qn.n > 0 AND dn.n > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM every)
SELECT query_id, id, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank, substr(text, 1, 200) AS preview
FROM top JOIN documents ON doc_id = id WHERE rank <= {k}
"""


@query("semantic_search_text", _search_text_sql())
def semantic_search_text(spark, sf):
    """P10 by text: the feature pipeline is fitted on the documents, stored and
    reloaded, and every benchmark text is searched with the documents' IDF."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/specgrade-embedder-{uuid.uuid4().hex}"
    FE.save_embedder(FE.fit_embedder(docs, "text", 256), path)
    return P.search_text(table(spark, sf, "benchmark").select("item_id", "text"), docs, FE.load_embedder(path), 5,
                         query_id="item_id", id_col="doc_id")
