"""Run registered queries against their DuckDB oracle and print a table.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from specgrade.plans.catalog import ORACLE, QUERIES  # noqa: E402
from specgrade.plans.compare import compare, duck_connection  # noqa: E402
from specgrade.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark()
    con = duck_connection(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLE:
                info = compare(df, con, ORACLE[n])
                ok = info["cols_match"] and info["values_match"]
            else:
                info = {"spark_rows": df.count(), "oracle": None}
                ok = True
        except Exception as e:  # report and continue
            info, ok = {"error": repr(e)[:800]}, False
        bad += not ok
        print(("OK  " if ok else "BAD ") + n, f"{time.time() - t:.1f}s", json.dumps(info, default=str)[:1500],
              flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
