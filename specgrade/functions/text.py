"""Text primitives with Python-``str`` semantics, as JVM-side Column expressions.

Spark's ``trim`` strips only spaces and Java's ``\\s`` is ASCII; the reference
uses Python ``str.strip``/``str.split``, whose whitespace set is the Unicode
White_Space property plus the four ASCII separators U+001C..U+001F.  All
helpers here reproduce that set so results match on any input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() set, written as a Java regex character class body
# ((?U)\s is Unicode White_Space, Python adds U+001C..U+001F).
PY_SPACE = r"\s\x1c-\x1f"
_WS_RUN_RE = rf"(?U)[{PY_SPACE}]+"
# The same set as literal characters, derived from Python's own rule; used
# with btrim, which strips a character set without a regex.
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(c), F.lit(PY_WS_CHARS))


def is_blank(c) -> Column:
    """True when null or only whitespace (null counts as blank)."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def normalize_text(c) -> Column:
    """``text.strip().replace('\\n', ' ')``."""
    return F.replace(py_strip(c), F.lit("\n"), F.lit(" "))


def char_length(c) -> Column:
    """Length in code points (Python ``len``), as bigint."""
    return F.length(_c(c)).cast("bigint")


def word_count(c) -> Column:
    """``len(text.split())``: number of whitespace-separated tokens."""
    s = py_strip(c)
    return (F.when(F.length(s) == 0, F.lit(0))
            .otherwise(F.size(F.split(s, _WS_RUN_RE)))).cast("bigint")


def lines(c) -> Column:
    """Split on ``\\n`` into an array of lines (no stripping)."""
    return F.split(_c(c), "\n")


def preview(c, n: int) -> Column:
    """First ``n`` code points (``text[:n]``)."""
    return F.substring(_c(c), 1, n)
