"""Time every registered query (noop sink) at a scale factor; slowest first."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from specgrade.plans.catalog import QUERIES  # noqa: E402
from specgrade.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark(shuffle_partitions=16)
    QUERIES["blog_pages"](spark, sf).write.format("noop").mode("overwrite").save()
    out = []
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - t, n))
    for t, n in sorted(out, reverse=True):
        print(f"{t:7.2f}s  {n}")
    print(f"total {sum(t for t, _ in out):.1f}s")


if __name__ == "__main__":
    main()
