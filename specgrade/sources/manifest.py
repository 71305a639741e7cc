"""URL manifests and output-name planning.

The transfer itself (HTTP download, decompression to disk) is not table
work and is not built; these operators plan it as tables: which urls, which
file names, which are already present, which outputs a file maps to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.functions.text import py_strip
from specgrade.functions.urls import PATH_RE


def url_manifest(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct non-blank urls with ``file_name`` = last path segment
    (``basename(urlparse(url).path)``, case preserved)."""
    u = urls.select(py_strip(url).alias("url")).filter(F.col("url") != "").distinct()
    path = F.regexp_extract(F.col("url"), "(?i)" + PATH_RE, 1)
    return u.withColumn("file_name", F.regexp_extract(path, r"([^/]*)$", 1))


def urls_from_string(spark, csv_list: str) -> DataFrame:
    """Comma-separated url list -> one-column table (blank items dropped)."""
    df = spark.createDataFrame([(csv_list,)], "s string")
    return df.select(F.explode(F.split("s", ",")).alias("url")).select(
        py_strip("url").alias("url")).filter(F.col("url") != "")


def urls_from_text(spark, path: str) -> DataFrame:
    """Text file, one url per line, blank lines dropped."""
    return spark.read.text(path).select(py_strip("value").alias("url")).filter(F.col("url") != "")


def pending_downloads(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows whose file is not yet present with size > 0.
    ``present`` has (file_name, size) e.g. from ``binaryFile`` metadata."""
    done = present.filter(F.col("size") > 0).select("file_name")
    return manifest.join(done, "file_name", "left_anti")


def output_name(name) -> Column:
    """Decompressed output name for a dump file; null = not a dump
    (unknown suffix) or already decompressed (``.json.jsonl``)."""
    n = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    known = n.endswith(".zst") | n.endswith(".gz")
    return F.when(~known, F.lit(None).cast("string")).otherwise(_suffix_map(n, stem))


def _suffix_map(n: Column, stem: Column) -> Column:
    def cut(k: int) -> Column:
        return F.substring(n, F.lit(1), F.length(n) - k)
    return (F.when(n.endswith(".jsonl.zst"), F.concat(cut(10), F.lit(".json.jsonl")))
            .when(n.endswith(".jsonl.gz"), F.concat(cut(9), F.lit(".json.jsonl")))
            .when(n.endswith(".json.zst"), F.concat(cut(9), F.lit(".json.jsonl")))
            .when(n.endswith(".json.gz"), F.concat(cut(8), F.lit(".json.jsonl")))
            .otherwise(F.concat(stem, F.lit(".jsonl"))))
