"""Numbered-list and response parsing (T1-T10, T16) as array HOF expressions.

Model output encodes a list as numbered lines ("1. ...\\n2. ...").  Every
parser here turns a text Column into an ``array<string>`` Column with
``split``/``regexp_extract_all`` + ``filter``/``transform``, so parsing runs
inside whole-stage codegen with no Python in the loop.  Patterns follow
Python ``re`` semantics: ``(?U)`` for Unicode ``\\d``/``\\s``/``\\b``,
``(?d)`` so ``^``/``$`` only see ``\\n``, and the Python whitespace set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specgrade.functions.text import PY_SPACE, py_strip

_W = f"[{PY_SPACE}]"
# Item separator, newline + optional spaces + "n." + spaces
ITEM_SPLIT_RE = rf"(?U)\n{_W}*\d+\.{_W}*"
ITEM_NUMBER_RE = rf"(?U)^\d+\.{_W}*"
CONSTRAINTS_PREFIX_RE = rf"(?iuU)^Constraints:{_W}*"
# Inline segments, "n. text" up to the next number or the end
SEGMENT_RE = rf"(?sdU)\b\d+\.{_W}*(.*?)(?={_W}*\d+\.{_W}*|$)"
# T4: lines starting (column 0) with digits and a dot
NUMBERED_LINE_RE = r"(?dmU)^\d+\."
# Task up to the constraints marker, constraints to the end
TASK_RE = rf"(?sdU)Main Task{_W}*:{_W}*(.*?){_W}*(?=Constraints{_W}*:|$)"
CONS_RE = rf"(?sU)Constraints{_W}*:{_W}*(.*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_numbered(text) -> Column:
    """T1 (line mode): drop a leading 'Constraints:', split at newline+number,
    drop blank pieces, strip each item's own number.  Null -> []."""
    s = F.regexp_replace(py_strip(_c(text)), CONSTRAINTS_PREFIX_RE, "")
    pieces = F.filter(F.split(s, ITEM_SPLIT_RE), lambda x: F.length(py_strip(x)) > 0)
    items = F.transform(pieces, lambda x: py_strip(F.regexp_replace(x, ITEM_NUMBER_RE, "")))
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_numbered_inline(text) -> Column:
    """T2 (segment mode): every 'n. ...' segment anywhere in the text,
    whitespace collapsed, empties dropped.  Splits decimals like '3.5'."""
    segs = F.regexp_extract_all(_c(text), F.lit(SEGMENT_RE), 1)
    cleaned = F.transform(segs, lambda x: py_strip(F.regexp_replace(x, f"(?U){_W}+", " ")))
    out = F.filter(cleaned, lambda x: F.length(x) > 0)
    return F.coalesce(out, F.array().cast("array<string>"))


def number_items(items) -> Column:
    """['a','b'] -> '1. a\\n2. b'."""
    return F.array_join(F.transform(_c(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def take_constraints(items, n: int = 23) -> Column:
    """First ``n`` items renumbered from 1, one per line."""
    return number_items(F.slice(_c(items), 1, n))


def count_numbered(text) -> Column:
    """T4: lines starting in column 0 with digits and a dot."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(NUMBERED_LINE_RE)), F.lit(0)).cast("bigint")


def count_digit_lines(text) -> Column:
    """T5: stripped non-blank lines not starting with 'Constraint' whose first
    character is a digit (no dot required)."""
    ls = F.transform(F.split(_c(text), "\n"), lambda x: py_strip(x))
    hit = F.filter(ls, lambda x: (F.length(x) > 0) & ~x.startswith("Constraint")
                   & x.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]"))
    return F.coalesce(F.size(hit), F.lit(0)).cast("bigint")


def _stripped_lines(text) -> Column:
    return F.transform(F.split(py_strip(_c(text)), "\n"), lambda x: py_strip(x))


def _classify(lines_: Column, is_task, is_cons) -> Column:
    """Each line once: struct(x, t = task line, c = constraints marker)."""
    return F.transform(lines_, lambda x: F.struct(x.alias("x"), is_task(x).alias("t"), is_cons(x).alias("c")))


def _split(cl: Column, task_value) -> Column:
    """Shared tail of T6/T7/T8 on classified lines."""
    pos = F.array_position(F.transform(cl, lambda s: s["c"]), F.lit(True))
    after = F.when(pos > 0, F.slice(cl, (pos + 1).cast("int"), F.size(cl) + 1))
    body = F.transform(F.filter(after, lambda s: (F.length(s["x"]) > 0) & ~s["t"] & ~s["c"]), lambda s: s["x"])
    last = F.try_element_at(F.filter(cl, lambda s: s["t"]), F.lit(-1))["x"]
    task = F.coalesce(task_value(last), F.lit(""))
    cons = F.coalesce(F.array_join(body, "\n"), F.lit(""))
    return F.struct(task.alias("main_task"), cons.alias("constraints"))


def _strict_flags(markers):
    def is_task(x):
        return x.startswith("Main Task:")

    def is_cons(x):
        out = F.lit(False)
        for m in markers:
            out = out | x.startswith(m)
        return out & ~is_task(x)
    return is_task, is_cons


def _strict_task(last):
    return py_strip(F.replace(last, F.lit("Main Task:"), F.lit("")))


def _lenient_flags():
    def is_task(x):
        return F.contains(F.lower(x), F.lit("main task"))

    def is_cons(x):
        return F.contains(F.lower(x), F.lit("constraints")) & ~is_task(x)
    return is_task, is_cons


def _lenient_task(last):
    return (F.when(F.contains(last, F.lit(":")), py_strip(F.regexp_extract(last, r"(?s)^[^:]*:(.*)$", 1)))
            .otherwise(py_strip(F.replace(last, F.lit("main task"), F.lit("")))))


def _lenient_lines(text):
    return F.transform(_stripped_lines(text), lambda x: py_strip(F.btrim(x, F.lit("*"))))


def with_task_split(df, text: str, out: str = "parsed", lenient: bool = False,
                    markers=("Constraints:",)):
    """T6/T7/T8 as a DataFrame step: the classified lines are projected once
    in their own column (Spark does not share a repeated higher-order
    subexpression), then split; adds struct ``out``(main_task, constraints)."""
    if lenient:
        cl = _classify(_lenient_lines(text), *_lenient_flags())
        task_value = _lenient_task
    else:
        cl = _classify(_stripped_lines(text), *_strict_flags(markers))
        task_value = _strict_task
    return df.withColumn("_sg_cl", cl).withColumn(out, _split(F.col("_sg_cl"), task_value)).drop("_sg_cl")


def split_task_constraints(text, markers=("Constraints:",)) -> Column:
    """T6/T7 strict: struct(main_task, constraints).

    'Main Task:' lines set the task (last wins, every marker occurrence
    removed); lines after the first constraints marker that are non-blank
    and not themselves markers form the constraints, newline-joined.
    Each line is classified once; the rest works on the flags.
    """
    cl = _classify(_stripped_lines(text), *_strict_flags(markers))
    return _split(cl, _strict_task)


def split_task_constraints_lenient(text) -> Column:
    """Asterisks stripped, case-insensitive *contains* 'main task' /
    'constraints'; any later line mentioning either phrase is dropped."""
    return _split(_classify(_lenient_lines(text), *_lenient_flags()), _lenient_task)


def extract_main_task(text) -> Column:
    """struct(main_task, constraints) by dot-all regexes; '' when absent."""
    t = F.coalesce(_c(text).cast("string"), F.lit("nan"))
    task = py_strip(F.regexp_extract(t, TASK_RE, 1))
    cons = py_strip(F.regexp_extract(t, CONS_RE, 1))
    return F.struct(task.alias("main_task"), cons.alias("constraints"))


def empty_parse_flag(constraints) -> Column:
    """True when the parsed constraints text is empty."""
    return F.coalesce(F.length(py_strip(_c(constraints))) == 0, F.lit(True))


def duplicate_items(items) -> Column:
    """Items beyond the first after lower-casing and stripping."""
    norm = F.transform(_c(items), lambda x: F.lower(py_strip(x)))
    return (F.size(norm) - F.size(F.array_distinct(norm))).cast("bigint")
