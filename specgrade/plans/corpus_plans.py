"""Registered queries for sources, url classification and corpus filters."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from specgrade.functions import text as T
from specgrade.functions import urls as U
from specgrade.operators import corpus as C
from specgrade.plans.registry import query
from specgrade.plans.sqlparts import BLOG_REASON, CORPUS, URL_PARTS, S
from specgrade.plans.tables import corpus_with_urls, table


@query("blog_pages", f"""
SELECT page_id, url, reason FROM (
  SELECT page_id, url, {BLOG_REASON} AS reason
  FROM (SELECT page_id, url, {URL_PARTS} FROM pages))
WHERE reason IS NOT NULL
""")
def blog_pages(spark, sf):
    """F1-F5 flagship: pages whose url marks a blog article, with the reason."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return U.classify_blog_url(pages, "url", "reason").filter(F.col("reason").isNotNull())


@query("url_parts", f"""
SELECT page_id, host, path FROM (SELECT page_id, {URL_PARTS} FROM pages)
""")
def url_parts(spark, sf):
    """lower-cased host (no userinfo/port) and path of every page url."""
    return U.with_url_parts(table(spark, sf, "pages").select("page_id", "url")).drop("url")


@query("blog_subdomain", f"""
SELECT page_id, url FROM (SELECT page_id, url, {URL_PARTS} FROM pages)
WHERE regexp_matches(host, '(^|\\.)blog[0-9]*\\.')
""")
def blog_subdomain(spark, sf):
    """hosts with a blog / blogN label."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.filter(U.url_host("url").rlike(U.SUBDOMAIN_RE))


@query("blog_domain_semi", f"""
WITH h AS (SELECT page_id, url, host FROM (SELECT page_id, url, {URL_PARTS} FROM pages)),
dom AS (SELECT DISTINCT substr(host, 6) AS d FROM h WHERE starts_with(host, 'blog.'))
SELECT page_id, url FROM h
WHERE EXISTS (SELECT 1 FROM dom WHERE h.host = dom.d OR ends_with(h.host, '.' || dom.d))
""")
def blog_domain_semi(spark, sf):
    """F2 as a semi-join against a domain table derived from the data: every
    parent domain of a blog.* host; matches that domain and all its subdomains."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    host = U.url_host("url")
    doms = (pages.filter(host.startswith("blog."))
                 .select(F.regexp_replace(host, r"^blog\.", "").alias("domain")).distinct())
    return U.blog_domain_semi(pages, doms, key="page_id")


@query("normalize_text", f"""
SELECT doc_id, replace({S}, chr(10), ' ') AS text, length(replace({S}, chr(10), ' ')) AS text_length
FROM documents
""")
def normalize_text(spark, sf):
    """strip, newline -> space, code-point length."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_text("text").alias("text")).withColumn(
        "text_length", T.char_length("text"))


@query("length_band", f"""
SELECT doc_id, length(replace({S}, chr(10), ' ')) AS text_length FROM documents
WHERE length(replace({S}, chr(10), ' ')) BETWEEN 1000 AND 2000
""")
def length_band(spark, sf):
    """F8: normalised length within the shipped 1000-2000 character band."""
    d = C.with_text_length(table(spark, sf, "documents").select("doc_id", "text"))
    return C.filter_length_band(d, 1000, 2000).select("doc_id", "text_length")


@query("parse_corpus", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, url, source, replace({S}, chr(10), ' ') AS text,
       length(replace({S}, chr(10), ' ')) AS text_length
FROM (SELECT c.*, {URL_PARTS} FROM {CORPUS} c)
WHERE coalesce(url, '') <> '' AND coalesce(text, '') <> ''
  AND length(replace({S}, chr(10), ' ')) BETWEEN 1000 AND 2000
  AND ({BLOG_REASON}) IS NOT NULL
""")
def parse_corpus(spark, sf):
    """url-tagged corpus -> raw_blogs (length band 1000-2000, blog urls)."""
    corpus = corpus_with_urls(spark, sf).withColumnRenamed("doc_id", "id")
    return C.parse_corpus(corpus, 1000, 2000).drop("created", "added")


@query("ingest_stats", f"""
SELECT source, count(*) AS lines,
       count(*) FILTER (WHERE coalesce(url, '') <> '' AND coalesce(text, '') <> ''
                        AND length(replace({S}, chr(10), ' ')) BETWEEN 1000 AND 2000
                        AND ({BLOG_REASON}) IS NOT NULL) AS kept
FROM (SELECT c.*, {URL_PARTS} FROM {CORPUS} c)
GROUP BY ROLLUP (source)
""")
def ingest_stats(spark, sf):
    """Lines seen / kept per source plus the grand total (rollup)."""
    corpus = corpus_with_urls(spark, sf)
    norm_len = T.char_length(T.normalize_text("text"))
    kept = ((F.coalesce(F.col("url"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "")
            & norm_len.between(1000, 2000) & U.blog_reason("url").isNotNull())
    return C.ingest_stats(corpus, "source", kept)


@query("word_band", f"""
SELECT doc_id, len(string_split_regex({S}, '\\s+')) AS word_count FROM documents
WHERE {S} <> '' AND len(string_split_regex({S}, '\\s+')) BETWEEN 150 AND 400
""")
def word_band(spark, sf):
    """texts with 150-400 whitespace tokens (empty texts dropped first)."""
    obs = Observation("word_band")
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.filter_word_band(d, 150, 400, observation=obs).select("doc_id", "word_count")


@query("take_first", f"""
SELECT doc_id, n_chars FROM documents
WHERE {S} <> '' AND len(string_split_regex({S}, '\\s+')) >= 100
ORDER BY doc_id LIMIT 100
""")
def take_first(spark, sf):
    """first 100 texts (by doc_id) after a >= 100 word filter."""
    d = C.filter_word_band(table(spark, sf, "documents").select("doc_id", "text", "n_chars"), 100)
    return C.take_first(d, 100, ["doc_id"]).select("doc_id", "n_chars")


@query("null_profile", """
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE d.doc_id IS NULL) AS doc_id_nulls,
       count(*) FILTER (WHERE lang IS NULL) AS lang_nulls,
       count(*) FILTER (WHERE quality IS NULL) AS quality_nulls,
       count(*) FILTER (WHERE toxic IS NULL) AS toxic_nulls,
       count(*) FILTER (WHERE d.doc_id IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL
                        AND toxic IS NOT NULL) AS n_complete_rows
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def null_profile(spark, sf):
    """per-column null counts of documents left-joined to labels."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return C.null_profile(j, ["doc_id", "lang", "quality", "toxic"])


@query("drop_null_rows", """
SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL
""")
def drop_null_rows(spark, sf):
    """rows of the documents/labels left join without nulls."""
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return C.drop_null_rows(d.join(lab, "doc_id", "left"))


@query("preview", """
SELECT doc_id, substr(text, 1, 200) AS preview FROM documents
""")
def preview(spark, sf):
    """200-character previews."""
    return C.truncate_preview(table(spark, sf, "documents").select("doc_id", "text"), 200).drop("text")


@query("row_number", """
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS row_number FROM conversations
""")
def row_number(spark, sf):
    """F16: positional numbering by (conv_id, turn) without a one-task window."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return C.assign_row_number(c, ["conv_id", "turn"])


def _sample_sql():
    from specgrade.functions.hashing import mix_sql
    return (f"SELECT doc_id, lang FROM documents ORDER BY {mix_sql('doc_id', '0', 7)}, doc_id LIMIT 50")


@query("sample_rows", _sample_sql())
def sample_rows(spark, sf):
    """seeded sample of 50 documents (smallest portable hashes)."""
    return C.sample_rows(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id", seed=7)


@query("url_manifest", """
SELECT url, regexp_extract(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '([^/]*)$', 1) AS file_name
FROM (SELECT DISTINCT trim(url) AS url FROM pages WHERE trim(url) <> '')
""")
def url_manifest(spark, sf):
    """Distinct non-blank urls with the file name a download would use."""
    from specgrade.sources.manifest import url_manifest as build
    return build(table(spark, sf, "pages").select("url")).select("url", "file_name")


# Urls of every form the rules tell apart, around each page's id.
_FORMS = ["https://u#.WordPress.com/2020/post", "//blog.example.org/x#", "http://example.org/blog;v=#", "  http://example.org/blogs/#",
          "http://example.org/blog/category/#/x", "http://example.org/blog/tag/#", "http://example.org/blog/author/#",
          "https://user:pw@blog2.example.org:8080/?q=#", "http://myblog.org/blogger/#", "http://example.org/a/b;blog/#",
          "gopher://example.org/blog;#", "http://example.org/?u=/blog/#", "http://notwordpress.com/#"]
_FORM_URL = ("CASE page_id % 14 " + " ".join(f"WHEN {i} THEN replace('{f}', '#', CAST(page_id AS VARCHAR(20)))" for i, f in enumerate(_FORMS))
             + " ELSE url END")


@query("url_forms", f"""
SELECT page_id, host, path, {BLOG_REASON} AS reason
FROM (SELECT page_id, {URL_PARTS} FROM (SELECT page_id, {_FORM_URL} AS url FROM pages))
""")
def url_forms(spark, sf):
    """F1-F5 on urls of every form: each domain, subdomain, path and exclusion
    rule fires, as do parameters, missing schemes and leading blanks."""
    pages = table(spark, sf, "pages").select("page_id", F.expr(_FORM_URL.replace("VARCHAR(20)", "STRING")).alias("url"))
    return U.classify_blog_url(U.with_url_parts(pages), "url", "reason").select("page_id", "host", "path", "reason")
