"""Compare Spark result types with DuckDB oracle result types per query."""

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from specgrade.plans.catalog import ORACLE, QUERIES  # noqa: E402
from specgrade.plans.compare import duck_connection  # noqa: E402
from specgrade.session import get_spark  # noqa: E402

MAP = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
       "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark()
    con = duck_connection(sf)
    bad = 0
    for name in sorted(ORACLE):
        st = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, sf).schema.fields}
        rel = con.sql(ORACLE[name])
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        for c, t in st.items():
            want = MAP.get(t, t)
            if dt.get(c) != want:
                bad += 1
                print(f"{name}.{c}: spark {t} vs duck {dt.get(c)}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
