"""FIXTURES url cases and Python-str text semantics."""

import pytest
from specgrade.functions import text as T
from specgrade.functions import urls as U

URL_CASES = [
    ("https://me.wordpress.com/a", "domain"), ("https://wordpress.com/", "domain"),
    ("https://notwordpress.com/", None), ("https://my_blog.blogspot.com/x", "domain"),
    ("https://blog.example.org/tag/x/", "subdomain"), ("https://www.blog2.example.org/", "subdomain"),
    ("https://myblog.example.org/", None), ("https://example.org/blog/post", "path"),
    ("https://example.org/blogs", "path"), ("https://example.org/blogging", None),
    ("https://example.org/blog/category/x", None), ("https://example.org/blog/tag/x", None),
    ("https://example.org/blog/author/x", None), ("HTTPS://Example.ORG/BLOG/", "path"),
    ("https://user:pw@blog.example.org:8080/x", "subdomain"), ("not a url", None), ("", None), (None, None),
]


def test_blog_url_cases(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URL_CASES)], "i int, url string")
    got = {r["i"]: r["r"] for r in df.select("i", U.blog_reason("url").alias("r")).collect()}
    for i, (u, want) in enumerate(URL_CASES):
        assert got[i] == want, (u, got[i], want)


def test_domain_semi_join_matches_regex(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URL_CASES)], "i int, url string")
    doms = spark.createDataFrame([(d,) for d in U.BLOG_DOMAINS], "domain string")
    semi = {r["i"] for r in U.blog_domain_semi(df, doms, key="i").collect()}
    rx = {i for i, (u, w) in enumerate(URL_CASES) if w == "domain"}
    assert semi == rx


@pytest.mark.parametrize("s", ["  a b  ", " x ", "\x1cy\x1f", "\ttab\n", "", "a "])
def test_strip_and_words_match_python(spark, s):
    r = spark.createDataFrame([(s,)], "t string").select(
        T.py_strip("t").alias("s"), T.word_count("t").alias("w"), T.normalize_text("t").alias("n")).first()
    assert r["s"] == s.strip()
    assert r["w"] == len(s.split())
    assert r["n"] == s.strip().replace("\n", " ")
