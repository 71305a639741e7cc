"""Parser cases from FIXTURES.md: numbered lists, verdicts, pairwise scores."""

import re

import pytest

from specgrade.functions import lists as L
from specgrade.functions import scoring as S
from specgrade.operators import lists as OL


def py_parse(text):
    text = re.sub(r"^Constraints:\s*", "", text.strip(), flags=re.IGNORECASE)
    parts = re.split(r"\n\s*\d+\.\s*", text)
    return [re.sub(r"^\d+\.\s*", "", c).strip() for c in parts if c.strip()]


def py_inline(text):
    seg = re.compile(r"\b\d+\.\s*(.*?)(?=\s*\d+\.\s*|$)", re.S)
    items = [re.sub(r"\s+", " ", s).strip() for s in seg.findall(text)]
    return [s for s in items if s]


LISTS = [
    "Constraints:\n" + "\n".join(f"{i}. item {i}" for i in range(1, 40)),
    "\n".join(f"{i}. c{i}" for i in range(1, 39)),
    "Preamble text\n1. a\n2. b",
    "1. a\n   2. b\n3. Use 3.5 percent",
    "1. a 2. b 3. c",
    "CONSTRAINTS: 1. x\r\n2. y",
    "1. a\n2.\n3. b",
    "",
]


@pytest.mark.parametrize("text", LISTS)
def test_parse_numbered_equals_python(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(L.parse_numbered("t").alias("a")).first()["a"]
    assert got == py_parse(text)


@pytest.mark.parametrize("text", LISTS)
def test_parse_inline_equals_python(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(L.parse_numbered_inline("t").alias("a")).first()["a"]
    assert got == py_inline(text)


def test_count_yes_cases(spark):
    text = "1. Yes - ok\n2. yes - lower\n3. Yesterday - no\n  4. Yes - indented\n5. No - x\nTotal: 9 Yes"
    r = spark.createDataFrame([(text,)], "t string").select(
        S.count_yes("t").alias("y"), S.count_strict_verdicts("t").alias("v17")).first()
    assert r["y"] == 2          # 1 and indented 4; lower-case and Yesterday not counted
    assert r["v17"] == 2        # 1 and 5 (indented 4 is not column 0)


def test_rate_zero_total(spark):
    r = spark.createDataFrame([(0, 0)], "n int, t int").select(S.satisfaction_rate("n", "t").alias("r")).first()
    assert r["r"] == 0.0


SCORE_CASES = [
    ("Grammar: A 4, B 3", (4, 3), (4, 3)),
    ("Grammar A (4) vs B (3)", (4, 3), (4, 3)),
    ("Grammar\nA 4/5\nB 3/5", (4, 3), (4, 3)),
    ("Grammar: A: 4.5 B: 4", (4.5, 4), (4.5, 4)),
    ("Grammar:\nA - 4/5\nB - 3/5", (4, 5), (4, 3)),
    ("Grammar: A: 4/5, B: 3/5", (4, 5), (4, 3)),
]


@pytest.mark.parametrize("seg,compat,fixed", SCORE_CASES)
def test_pair_score_modes(spark, seg, compat, fixed):
    df = spark.createDataFrame([(seg,)], "t string")
    c = df.select(S.parse_pair_scores("t", "compat").alias("p")).first()["p"]
    f = df.select(S.parse_pair_scores("t", "fixed").alias("p")).first()["p"]
    assert (c["grammar_score_A"], c["grammar_score_B"]) == compat
    assert (f["grammar_score_A"], f["grammar_score_B"]) == fixed


def test_no_scores_is_null(spark):
    df = spark.createDataFrame([("nothing here",)], "t string")
    assert df.select(S.parse_pair_scores("t").alias("p")).first()["p"] is None


def test_bucket_cases(spark):
    rows = [(1, "\n".join(f"{i}. c{i}" for i in range(1, 40))),
            (2, "\n".join(f"{i}. c{i}" for i in range(1, 21))), (3, "")]
    df = spark.createDataFrame(rows, "k int, constraints string")
    got = {}
    for r in OL.expand_buckets(df).collect():
        got.setdefault(r["k"], []).append(r["subset_size"])
    assert sorted(got[1]) == [7, 15, 23, 31, 39]
    assert sorted(got[2]) == [7, 15, 20, 20, 20]
    assert got[3] == [0] * 5
    # prefix property: every bucket is a prefix of the next
    sel = {(r["k"], r["subset_size"]): r["selected_constraints"] for r in OL.expand_buckets(df).collect()}
    assert sel[(1, 15)].startswith(sel[(1, 7)])


def test_split_task_lenient_drops_mentions(spark):
    t = "**Main Task:** Write\nConstraints:\n1. keep\n2. mention constraints here\n3. ok"
    r = spark.createDataFrame([(t,)], "t string").select(L.split_task_constraints_lenient("t").alias("s")).first()["s"]
    assert r["main_task"] == "** Write"  # text after the first colon, as the reference splits it
    assert r["constraints"] == "1. keep\n3. ok"


def _random_lists(n=400, seed=11):
    import random
    rng = random.Random(seed)
    atoms = ["1.", "2.", "12.", "3.5", " ", "  ", "\n", "\t", "a", "ab", "x9", "_", "é", "-", ".", "7", " ", "Q"]
    return [(i, "".join(rng.choice(atoms) for _ in range(rng.randint(0, 14)))) for i in range(n)]


def test_inline_segments_sql_equals_python_and_spark(spark):
    """The oracle's look-ahead-free segment scan, the Spark parser and Python
    re agree on random texts (markers glued to words, decimals, empty items)."""
    import duckdb

    from specgrade.plans.sqlparts import inline_segments_sql

    rows = _random_lists()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got_sql = {}
    for k, pos, seg in con.execute(f"SELECT * FROM {inline_segments_sql('t', 'doc_id', 'text')} ORDER BY 1, 2").fetchall():
        got_sql.setdefault(k, []).append(seg)
    got_spark = {r["k"]: list(r["a"]) for r in spark.createDataFrame(rows, "k long, t string").select(
        "k", L.parse_numbered_inline("t").alias("a")).collect()}
    for k, text in rows:
        want = py_inline(text)
        assert got_sql.get(k, []) == want, (text, got_sql.get(k))
        assert got_spark[k] == want, (text, got_spark[k])
