"""Scoring expressions over model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specgrade.functions.text import PY_SPACE

_W = f"[{PY_SPACE}]"
# A1: verdict lines; a leading indent is allowed, case-sensitive Yes/No word
VERDICT_RE = rf"(?dmU)^{_W}*\d+\.{_W}*(Yes|No)\b"
# A2: verdict rows with number and reason
VERDICT_ROW_RE = rf"(?dmU)^{_W}*(\d+)\.{_W}*(Yes|No)\b[ \t]*-?[ \t]*([^\n]*)"
# Strict verdict line "n. Yes - ..."
STRICT_VERDICT_RE = rf"(?dmU)^\d+\.{_W}+(Yes|No){_W}+-"

CATEGORIES = ("Grammar", "Coherence", "Likability")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_yes(results) -> Column:
    """A1: number of 'n. Yes' verdict lines (any self-reported total ignored)."""
    v = F.regexp_extract_all(_c(results), F.lit(VERDICT_RE), 1)
    return F.coalesce(F.size(F.filter(v, lambda x: x == "Yes")), F.lit(0)).cast("bigint")


def count_strict_verdicts(results) -> Column:
    """Lines exactly like 'n. Yes - ...' / 'n. No - ...' from column 0."""
    return F.coalesce(F.regexp_count(_c(results), F.lit(STRICT_VERDICT_RE)), F.lit(0)).cast("bigint")


def verdict_rows(results) -> Column:
    """A2: array<struct<idx bigint, verdict string, reason string>>."""
    r = _c(results)
    nums = F.regexp_extract_all(r, F.lit(VERDICT_ROW_RE), 1)
    verdicts = F.regexp_extract_all(r, F.lit(VERDICT_ROW_RE), 2)
    reasons = F.regexp_extract_all(r, F.lit(VERDICT_ROW_RE), 3)
    z = F.arrays_zip(nums.alias("idx"), verdicts.alias("verdict"), reasons.alias("reason"))
    return F.transform(z, lambda s: F.struct(s["idx"].cast("bigint").alias("idx"),
                                             s["verdict"].alias("verdict"),
                                             F.trim(s["reason"]).alias("reason")))


def satisfaction_rate(num, total) -> Column:
    """A4: num/total, 0.0 when total is 0 (not clamped)."""
    n, t = _c(num), _c(total)
    return F.when(t > 0, n.cast("double") / t).otherwise(F.lit(0.0))


def compression_ratio(summary_len, original_len, failed=None) -> Column:
    """len(summary)/len(original); 0 for an empty original; 1.0 on failure."""
    s, o = _c(summary_len), _c(original_len)
    r = F.when(o > 0, s.cast("double") / o).otherwise(F.lit(0.0))
    if failed is not None:
        r = F.when(_c(failed), F.lit(1.0)).otherwise(r)
    return r


# ---------------------------------------------------------------- A13 / A14
_NUM = r"([0-9]+(?:[.,][0-9]+)?)"
# ---- fixed values (must equal the reference for identical results) ----------
COMPAT_PAIR_RE = r"(?iU)A[^0-9\r\n\-:]*([0-9]+(?:[.,][0-9]+)?)\D+B[^0-9\r\n\-:]*([0-9]+(?:[.,][0-9]+)?)"
COMPAT_LINE_RE = {
    "A": r"(?iU)(^|\n)\s*A[^0-9A-Za-z\r\n\-:]{0,3}([0-9]+(?:[.,][0-9]+)?)(?:\s*/\s*[0-9]+)?",
    "B": r"(?iU)(^|\n)\s*B[^0-9A-Za-z\r\n\-:]{0,3}([0-9]+(?:[.,][0-9]+)?)(?:\s*/\s*[0-9]+)?",
}
# ------------------------------------------------------------------------------
FIXED_RE = {L: rf"\b{L}\b\s*[-:(=]*\s*{_NUM}" for L in "AB"}


def category_segment(text, category: str) -> Column:
    """Text from the category heading (case-insensitive) to the next other
    heading or the end; null when the heading is absent."""
    txt = F.replace(_c(text), F.lit("\r"), F.lit("\n"))
    low = F.lower(txt)
    start = F.position(F.lit(category.lower()), low)
    others = [k.lower() for k in CATEGORIES if k != category]
    ends = [F.position(F.lit(k), low, start + 1) for k in others]
    big = F.length(txt) + 1
    end = F.least(*[F.when(e > 0, e).otherwise(big) for e in ends])
    return F.when(start > 0, F.substring(txt, start, end - start))


def _num(c: Column) -> Column:
    return F.when(c != "", F.replace(c, F.lit(","), F.lit(".")).cast("double"))


def category_scores(text, category: str, mode: str = "fixed", seg: Column | None = None) -> Column:
    """struct(a double, b double) for one category, null fields when absent.
    ``seg`` may be a precomputed segment column (see with_pair_scores)."""
    seg = category_segment(text, category) if seg is None else seg
    nums = F.regexp_extract_all(seg, F.lit(_NUM), 1)
    fb_a = F.when(F.size(nums) >= 2, _num(F.get(nums, 0)))
    fb_b = F.when(F.size(nums) >= 2, _num(F.get(nums, 1)))
    if mode == "compat":
        pa = _num(F.regexp_extract(seg, COMPAT_PAIR_RE, 1))
        pb = _num(F.regexp_extract(seg, COMPAT_PAIR_RE, 2))
        la = _num(F.regexp_extract(seg, COMPAT_LINE_RE["A"], 2))
        lb = _num(F.regexp_extract(seg, COMPAT_LINE_RE["B"], 2))
        a = F.when(pa.isNotNull(), pa).when(la.isNotNull() & lb.isNotNull(), la).otherwise(fb_a)
        b = F.when(pa.isNotNull(), pb).when(la.isNotNull() & lb.isNotNull(), lb).otherwise(fb_b)
    elif mode == "fixed":
        fa = _num(F.regexp_extract(seg, FIXED_RE["A"], 1))
        fb = _num(F.regexp_extract(seg, FIXED_RE["B"], 1))
        both = fa.isNotNull() & fb.isNotNull()
        a = F.when(both, fa).otherwise(fb_a)
        b = F.when(both, fb).otherwise(fb_b)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.struct(a.alias("a"), b.alias("b"))


def parse_pair_scores(text, mode: str = "fixed", segments: dict | None = None) -> Column:
    """A13+A14: struct of six scores (missing -> 0.0) and four preferences;
    the whole struct is null when no category yielded a number (A18)."""
    segments = segments or {}
    parts = {c: category_scores(text, c, mode, segments.get(c)) for c in CATEGORIES}
    any_found = F.lit(False)
    fields = []
    a_wins = F.lit(0)
    prefs = []
    for c, s in parts.items():
        any_found = any_found | s["a"].isNotNull() | s["b"].isNotNull()
        sa, sb = F.coalesce(s["a"], F.lit(0.0)), F.coalesce(s["b"], F.lit(0.0))
        fields += [sa.alias(f"{c.lower()}_score_A"), sb.alias(f"{c.lower()}_score_B")]
        pref = F.when(sa >= sb, F.lit("A")).otherwise(F.lit("B"))
        prefs.append(pref.alias(f"{c.lower()}_pref"))
        a_wins = a_wins + F.when(sa >= sb, 1).otherwise(0)
    overall = F.when(a_wins >= F.lit(len(CATEGORIES)) - a_wins, F.lit("A")).otherwise(F.lit("B"))
    return F.when(F.coalesce(any_found, F.lit(False)),
                  F.struct(*fields, *prefs, overall.alias("overall_pref")))


def has_pair_scores(text) -> Column:
    """Whether ``parse_pair_scores`` finds anything: in either mode a category
    scores exactly when its segment holds two numbers, so this is the parse's
    outcome at a fraction of its cost (A18)."""
    found = F.lit(False)
    for c in CATEGORIES:
        found = found | (F.size(F.regexp_extract_all(F.coalesce(category_segment(text, c), F.lit("")), F.lit(_NUM), 1)) >= 2)
    return found


def ab_order(key, seed: int = 42) -> Column:
    """Reproducible 0/1 presentation order per row (1 = swapped), from
    the portable seeded mix so it does not depend on partitioning."""
    from specgrade.functions.hashing import mix
    return F.pmod(mix(_c(key), F.lit(0), seed), F.lit(2)).cast("int")


def unswap(order, a_val, b_val) -> Column:
    """struct(first, second) = scores mapped back to the source articles."""
    o = _c(order)
    return F.struct(F.when(o == 1, _c(b_val)).otherwise(_c(a_val)).alias("first"),
                    F.when(o == 1, _c(a_val)).otherwise(_c(b_val)).alias("second"))


def with_pair_scores(df, text: str, mode: str = "fixed", out: str = "pair_scores"):
    """A13 as a DataFrame step: the three category segments are projected
    once, then parsed, which keeps each generated method small enough for
    whole-stage codegen."""
    segs = {c: f"_sg_seg_{c.lower()}" for c in CATEGORIES}
    d = df.withColumns({name: category_segment(text, c) for c, name in segs.items()})
    d = d.withColumn(out, parse_pair_scores(text, mode, {c: F.col(n) for c, n in segs.items()}))
    return d.drop(*segs.values())
