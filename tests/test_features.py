"""Text features (P1): the SQL twin of the feature hashing equals Spark's
HashingTF bucket for every token, and embeddings are unit vectors."""

import random

import duckdb
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from specgrade.operators.features import TOKEN_PATTERN, embed_text
from specgrade.plans.sqlparts import hashed_tokens_sql


def test_sql_feature_hash_equals_hashingtf(spark):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789_"
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 23))) for _ in range(300)})
    dim = 1 << 18
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS k, ? AS text", [" ".join(words)])
    got = {tok: b for _, tok, b in con.execute(f"SELECT * FROM {hashed_tokens_sql('t', 'k', 'text', dim)}").fetchall()}
    df = spark.createDataFrame([(w, [w]) for w in words], "w string, toks array<string>")
    want = {r["w"]: int(r["v"].indices[0])
            for r in HashingTF(inputCol="toks", outputCol="v", numFeatures=dim).transform(df).collect()}
    assert got == want


def test_sql_tokenizer_splits_like_regex_tokenizer(spark):
    from pyspark.ml.feature import RegexTokenizer
    text = "Hello, World!  snake_case\tX9 — café  done.\nÜber 3.5"
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS k, ? AS text", [text])
    toks = [r[1] for r in con.execute(f"SELECT * FROM {hashed_tokens_sql('t', 'k', 'text', 256)}").fetchall()]
    tok = RegexTokenizer(inputCol="text", outputCol="t", pattern=TOKEN_PATTERN, minTokenLength=1)
    want = tok.transform(spark.createDataFrame([(text,)], "text string")).first()["t"]
    assert toks == list(want)


def test_embed_text_unit_vectors(spark):
    d = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha gamma")], "vec_id long, text string")
    e = embed_text(d, "text", 64)
    norms = [r["n"] for r in e.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()]
    assert all(abs(n - 1.0) < 1e-12 for n in norms)


def test_texts_of_any_script_get_a_vector(spark):
    from specgrade.operators import pairing as P
    rows = [(1, "Привет мир"), (2, "你好 世界"), (3, "hello world"), (4, "..."), (5, "")]
    v = embed_text(spark.createDataFrame(rows, "vec_id long, text string"))
    assert {r["_id"] for r in P.prepare_vectors(v, normalize=False).collect()} == {1, 2, 3}
