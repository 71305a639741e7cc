"""Blog-URL classification as Column expressions (no per-row Python).

Host/path are pulled out with regexes rather than ``parse_url``: Spark's
URL parser rejects hosts with ``_`` and paths with spaces or ``|``, while the
classification has to accept them (hosts like ``my_blog.blogspot.com``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference for identical results) ----------
# Blogging platforms whose host, or any subdomain of it, marks a blog page.
BLOG_DOMAINS = [
    "wordpress.com", "blogspot.com", "medium.com", "substack.com",
    "tumblr.com", "ghost.io", "weebly.com", "wixsite.com", "squarespace.com",
    "livejournal.com", "typepad.com", "hubpages.com", "dev.to", "hashnode.dev",
    "github.io", "gitlab.io", "netlify.app", "vercel.app",
    "notion.site", "over-blog.com", "canalblog.com",
    "hatena.ne.jp", "ameblo.jp", "blog.sina.com.cn",
]
# Path segments that mark a listing page rather than an article.
BLOG_PATH_EXCLUDES = ["/category/", "/tag/", "/author/"]
# Host labels and path segments of a blog.
SUBDOMAIN_RE = r"(?U)(^|\.)blog\d*\."
BLOG_PATH_RE = r"/(blog|blogs)(/|$)"
# Schemes whose paths may carry parameters.
PARAM_SCHEMES = ["ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# ------------------------------------------------------------------------------

SCHEME = r"[a-z][a-z0-9+.\-]*"
HOST_RE = rf"^(?:{SCHEME}:)?//(?:[^/?#]*@)?([^/?#:]*)"
PATH_RE = rf"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
# A last path segment ends at ";" (its parameters) without a scheme or with one of these
OTHER_SCHEME_RE = rf"^(?!(?:{'|'.join(PARAM_SCHEMES)}):){SCHEME}:"
LEADING = "".join(map(chr, range(33)))  # blanks and control characters before a url


def domain_regex(domains=BLOG_DOMAINS) -> str:
    return r"(?:^|\.)(?:%s)$" % "|".join(re.escape(d) for d in domains)


def _plain(url) -> Column:
    """Lower-cased url without leading blanks and without tabs and line ends."""
    u = F.lower(F.col(url) if isinstance(url, str) else url)
    return F.translate(F.ltrim(u, F.lit(LEADING)), "\t\r\n", "")


def url_host(url) -> Column:
    return F.regexp_extract(_plain(url), HOST_RE, 1)


def url_path(url) -> Column:
    u = _plain(url)
    path = F.regexp_extract(u, PATH_RE, 1)
    return F.when(u.rlike(OTHER_SCHEME_RE), path).otherwise(F.regexp_replace(path, ";[^/]*$", ""))


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """add lower-cased ``host`` and ``path`` columns."""
    return df.withColumns({"host": url_host(url), "path": url_path(url)})


def blog_reason(url, domains=BLOG_DOMAINS) -> Column:
    """F2-F5: 'domain' | 'subdomain' | 'path' | null, in that precedence.

    The listing-page exclusion applies only to the path branch.
    (Column form; ``classify_blog_url`` projects host/path once first.)
    """
    return blog_reason_from(url_host(url), url_path(url), domains)


def blog_reason_from(host: Column, path: Column, domains=BLOG_DOMAINS) -> Column:
    """F2-F5 on already extracted host and path columns."""
    if isinstance(host, str):
        host = F.col(host)
    if isinstance(path, str):
        path = F.col(path)
    excluded = F.lit(False)
    for seg in BLOG_PATH_EXCLUDES:
        excluded = excluded | F.contains(path, F.lit(seg))
    return (F.when(host.rlike(domain_regex(domains)), F.lit("domain"))
            .when(host.rlike(SUBDOMAIN_RE), F.lit("subdomain"))
            .when(path.rlike(BLOG_PATH_RE) & ~excluded, F.lit("path")))


def classify_blog_url(df: DataFrame, url: str = "url", out: str = "blog_reason") -> DataFrame:
    """add ``out`` (null when not a blog page).  Host and path are
    projected once, then every rule reads the columns."""
    return (df.withColumns({"_sg_host": url_host(url), "_sg_path": url_path(url)})
              .withColumn(out, blog_reason_from("_sg_host", "_sg_path"))
              .drop("_sg_host", "_sg_path"))


def host_suffixes(host) -> Column:
    """All dot-suffixes of a host: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(F.col(host) if isinstance(host, str) else host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n),
                       lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


# a bitmap of the native bitmap functions has this many bits
BITMAP_BITS = 32768
MAX_BITMAPS = 1024  # 4 MB of bitmaps at most


def domain_bitmaps(domains: DataFrame, n_domains: int) -> tuple[DataFrame, int]:
    """(bucket, bits): one-hash Bloom filter of the column ``_sg_sfx``, about 16 bits a
    domain, MAX_BITMAPS bitmaps at most, and the number of its bits."""
    bitmaps = max(1, min(MAX_BITMAPS, -(-16 * n_domains // BITMAP_BITS)))
    place = _bitmap_place(bitmaps)
    made = domains.groupBy(F.bitmap_bucket_number(place).alias("_sg_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_sg_bits"))
    return made, bitmaps


def _bitmap_place(bitmaps: int) -> Column:
    """The place of a suffix among all bits, from 1."""
    return F.pmod(F.xxhash64("_sg_sfx"), F.lit(bitmaps * BITMAP_BITS)) + 1


def suffix_candidates(df: DataFrame, domains: DataFrame, key: str, url: str = "url", domain_col: str = "domain") -> DataFrame:
    """(key, _sg_sfx) for the host suffixes that may be listed domains.  The
    domains' Bloom filter (a broadcast of at most 4 MB) is asked map side, so
    a suffix that is no domain, such as the one most hosts end with, is gone
    before anything is shuffled but for the filter's few false hits."""
    dom = domains.select(F.lower(F.col(domain_col)).alias("_sg_sfx"))
    bitmaps, n = domain_bitmaps(dom, dom.count())
    sfx = df.select(key, F.explode(host_suffixes(url_host(url))).alias("_sg_sfx")).withColumn("_sg_at", _bitmap_place(n))
    bit = F.bitmap_bit_position("_sg_at")
    byte = F.conv(F.hex(F.substring("_sg_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    met = sfx.join(F.broadcast(bitmaps), F.bitmap_bucket_number("_sg_at") == F.col("_sg_bucket"))
    return met.filter(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(key, "_sg_sfx")


def blog_domain_semi(df: DataFrame, domains: DataFrame, key: str, url: str = "url",
                     domain_col: str = "domain", heavy: int = 1024) -> DataFrame:
    """F2 for long domain lists: rows whose host equals or is a subdomain of
    any entry of ``domains`` (``key`` must identify a row of ``df``).

    Each row's few host suffixes are first put to the domains' Bloom filter
    (``suffix_candidates``); what passes meets the domain table in an
    equi-join, linear in both inputs, with no regex alternation over the list.
    Suffixes that over 1/``heavy`` of the candidates share (counted; fewer
    than ``heavy``) are settled map side, so a listed domain of most hosts is
    no hot key.  Only (key, suffix) pairs are shuffled, never the wide rows."""
    found = suffix_candidates(df, domains, key, url, domain_col)
    dom = domains.select(F.lower(F.col(domain_col)).alias("_sg_sfx")).distinct()
    total = found.agg(F.count(F.lit(1))).scalar()
    often = found.groupBy("_sg_sfx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * heavy > total).select("_sg_sfx")
    common = often.join(dom, "_sg_sfx", "left_semi")
    hits = (found.join(F.broadcast(common), "_sg_sfx", "left_semi")
            .unionByName(found.join(F.broadcast(often), "_sg_sfx", "left_anti").join(dom, "_sg_sfx", "left_semi"))).select(key)
    return df.join(hits, key, "left_semi")
