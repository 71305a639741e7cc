"""Every registered query equals its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally); queries without an oracle must run."""

import pytest

from specgrade.plans.catalog import ORACLE, QUERIES
from specgrade.plans.compare import compare

from conftest import SF01


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck01, name):
    df = QUERIES[name](spark, SF01)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    info = compare(df, duck01, ORACLE[name])
    assert info["cols_match"], info
    assert info["values_match"], info


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["page_id", "url", "reason"]
    assert set(e.oracle_sql()) <= set(e.queries())
