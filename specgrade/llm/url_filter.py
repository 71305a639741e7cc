"""URL filters: rules first, gradient-boosted trees for the rest.

A rule is (verdict, host, path): it fits its host and every subdomain if the
url's path starts with the rule's; the longest fitting rule wins.  Urls that
a rule decides are the labelled urls; trees trained on them judge the others
by lexical features: length, depth, digit ratio, entropy, parameter counts,
host shape and suffix statistics.  Only DataFrame functions and
``pyspark.ml`` are used.

A suffix is the last two labels of the host.  Its statistic is the smoothed
share of blocked urls among the labelled ones, kept per hash bucket of the
suffix, so the table has at most ``suffix_buckets`` rows and is broadcast.
Labelled urls fall into two folds by hash and learn from the statistic of the
other fold, so none sees its own label.  The trees are fitted on a bounded
sample, the ``train_rows`` labelled urls of the smallest hash; both labels
weigh the same in it.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the trees like any other.  If no url is
labelled, or all labels agree, the verdict of unlabelled urls is that one
verdict (allow if there is none).  Repeated rows each get their row; an empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import ascii_lower, cut

# Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digit_ratio", "f_entropy", "f_params",
            "f_query_length", "f_fragment", "f_hyphens", "f_path_end", "f_suffix"]


def with_host_path(df: DataFrame) -> DataFrame:
    after = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(after, F.lit(""))
    return df.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equal length, the longer host."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def with_features(df: DataFrame, buckets: int) -> DataFrame:
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    exact = {
        "f_length": F.length(url), "f_host_length": F.length("host"), "f_depth": F.size(F.regexp_extract_all("path", F.lit("[^/]+"), F.lit(0))),
        "f_labels": F.size(F.split("host", r"\.")), "f_digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n, "f_entropy": entropy(url),
        "f_params": F.size(F.regexp_extract_all(query, F.lit("[^&;]+"), F.lit(0))), "f_query_length": F.length(query),
        "f_fragment": F.instr(url, "#") > 0, "f_hyphens": F.regexp_count("host", F.lit("-")),
        "f_path_end": F.when(F.endswith("path", F.lit("/")), 0).when(F.regexp_like("path", F.lit(r"\.[a-z0-9]+$")), 1).otherwise(2),
    }
    suffix = F.substring_index("host", ".", -2)
    return df.withColumns({k: c.cast("double") for k, c in exact.items()} | {"bucket": F.pmod(F.xxhash64(suffix), F.lit(buckets))})


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, train_rows: int = 20_000, suffix_buckets: int = 4096,
               trees: int = 12, depth: int = 4, prior: float = 20.0, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score
    (estimated probability of block; the trees' also where a rule decides)."""
    parsed = with_host_path(pages.select("page_id", "url"))
    rule, decided = rule_columns(RULES if rules is None else rules)
    urls = with_features(parsed.withColumns({"rule": rule, "decided": decided}), suffix_buckets)
    labelled = urls.filter("decided IS NOT NULL").withColumn("label", (F.col("decided") == "block").cast("double"))
    odd = F.pmod(F.xxhash64("url"), F.lit(2)) == 1
    sums = {"blocked": F.sum("label"), "seen": F.count(F.lit(1)).cast("double"), "odd_blocked": F.sum(F.when(odd, F.col("label")).otherwise(0.0)), "odd_seen": F.sum(odd.cast("double"))}
    stats = cut(labelled.groupBy("bucket").agg(*[c.alias(k) for k, c in sums.items()]))  # at most suffix_buckets rows
    all_blocked, all_seen = stats.agg(F.coalesce(F.sum("blocked"), F.lit(0.0)), F.coalesce(F.sum("seen"), F.lit(0.0))).first()
    out = ["page_id", "host", "path", "rule"]
    if all_blocked in (0.0, all_seen):  # nothing to tell apart
        score = float(all_seen > 0 and all_blocked == all_seen)
        return urls.select(*out, F.coalesce("decided", F.lit("block" if score else "allow")).alias("verdict"), F.lit(score).alias("score"))
    share = all_blocked / all_seen

    def with_suffix(df, blocked, seen):
        blocked, seen = F.coalesce(blocked, F.lit(0.0)), F.coalesce(seen, F.lit(0.0))
        return df.join(F.broadcast(stats), "bucket", "left").withColumn("f_suffix", (blocked + prior * share) / (seen + prior))

    def other_fold(name):
        return F.when(odd, F.col(name) - F.col(f"odd_{name}")).otherwise(F.col(f"odd_{name}"))

    sample = labelled.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(train_rows)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features")
    weight = F.when(F.col("label") == 1.0, 0.5 / share).otherwise(0.5 / (1 - share))  # both labels weigh the same
    train = cut(assembled.transform(with_suffix(sample, other_fold("blocked"), other_fold("seen"))).select("features", "label", weight.alias("weight")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="weight", seed=7).fit(train)
    scored = model.transform(assembled.transform(with_suffix(urls, F.col("blocked"), F.col("seen"))))
    score = vector_to_array("probability")[1]
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("score", score).select(*out, F.coalesce("decided", judged).alias("verdict"), "score")
