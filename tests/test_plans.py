"""Plan properties that matter at scale, checked on the physical plans of
the registered queries: no cross or nested-loop joins anywhere, no Python
UDFs (only the kNN scorer's Arrow-batched mapInPandas), unused columns
pruned from the scan, bounded lookups pushed into the scan."""

import io
from contextlib import redirect_stdout

import pytest

from specgrade.plans.catalog import QUERIES

from conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


# the exact top-k scorer is the only Python in a query plan (Arrow batches)
PYTHON_OK = {"knn_top10", "embed_knn", "semantic_search_text"}
# a user's model is Python by nature
USER_MODEL = {"embed_with_model"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "BatchEvalPython" not in plan and ("ArrowEvalPython" in plan) == (name in USER_MODEL), name  # no Python UDF
    assert ("MapInPandas" in plan) == (name in PYTHON_OK), name


def test_pages_html_never_read(spark):
    for name in ("parse_corpus", "blog_pages", "url_parts"):
        plan = _plan(QUERIES[name](spark, SF001))
        schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
        assert schemas and not any("html" in line for line in schemas), name


@pytest.mark.parametrize("name", ["distinct_pairs", "semantic_search"])
def test_bounded_text_lookup_is_pushed_down(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert any("PushedFilters" in line and "In(doc_id" in line for line in plan.splitlines()), name


TEXTS = ("text#", "messages#", "base_content#", "constraints#", "selected_constraints#", "_sg_text#", "fitted_content#", "error#")


def _blocks(plan: str, operator: str) -> list[str]:
    """The details of every node of an operator in a formatted plan."""
    return [b for b in plan.split("\n\n") if b.strip().split("\n")[0].split(") ")[-1].startswith(operator)]


@pytest.mark.parametrize("name", ["dedupe_first", "attach_responses", "base_stage", "fit_stage", "constraints_stage", "merge_stage",
                                  "dedupe_requests", "join_fit", "evaluate_stage"])
def test_no_aggregate_carries_a_text(spark, name):
    """Dedupe, prompt dedupe and response joins aggregate keys, numbers and
    hashes; texts are fetched afterwards."""
    plan = _plan(QUERIES[name](spark, SF001))
    assert _blocks(plan, "HashAggregate") or _blocks(plan, "SortAggregate") or _blocks(plan, "ObjectHashAggregate")
    for kind in ("SortAggregate", "HashAggregate", "ObjectHashAggregate"):
        for block in _blocks(plan, kind):
            assert not any(t in block for t in TEXTS), block


def test_operators_aggregate_no_text(spark):
    """The operators themselves, on tables with a wide text column."""
    from specgrade.operators import inference as I
    from specgrade.operators import joins as J
    df = spark.createDataFrame([(1, 2, "text")], "key long, o int, text string")
    resp = spark.createDataFrame([("r", 1, 1, "t", 1, 1, None)], "request_id string, key long, attempt int, text string, input_tokens long, output_tokens long, error string")
    reqs = I.build_requests(df, "s", "key", "{t}", {"t": "text"})
    for made in (J.dedupe_first(df, "key", "o"), I.attach_responses(df.drop("text"), resp, "key", "out"), I.latest_attempt(resp),
                 I.retry_plan(reqs, resp), J.replicate_left(df, resp, "key", ["error"])):
        plan = _plan(made)
        for kind in ("SortAggregate", "HashAggregate", "ObjectHashAggregate"):
            for block in _blocks(plan, kind):
                assert "text#" not in block and "messages#" not in block, block


def test_zip_join_sorts_no_text(spark):
    """The range sort of a positional pairing holds order columns and hashes."""
    from specgrade.operators import joins as J
    df = spark.createDataFrame([(i, "text" * 9) for i in range(50)], "k long, text string")
    plan = _plan(J._positions(df.selectExpr("*", "xxhash64(k) AS _sg_h1", "xxhash64(text) AS _sg_h2"), ["k"]))
    assert "text#" not in plan
