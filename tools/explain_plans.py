"""Write the physical plan tree of the headline queries to docs/PLANS.md.

usage: python tools/explain_plans.py [sf_dir]
"""

import io
import os
import sys
from contextlib import redirect_stdout

ROOT = __file__.rsplit("/tools/", 1)[0]
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from specgrade.plans.catalog import QUERIES  # noqa: E402
from specgrade.session import get_spark  # noqa: E402


def plan_tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, details = [], []
    in_tree = True
    for line in text.splitlines():
        if line.startswith("(") and in_tree:
            in_tree = False
        if in_tree:
            tree.append(line)
        elif line.startswith(("ReadSchema", "PushedFilters", "Join type", "Arguments")):
            details.append("    " + line[:220])
    return "\n".join(tree).rstrip() + "\n\n" + "\n".join(details)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark(shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"`df.explain('formatted')` at `{sf}` (local[8], AQE on; final plans may change at run time).",
           "Iterative operators (distinct_pairs, knn_pairs) show the plan of their final result only.", ""]
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        doc = (QUERIES[name].__doc__ or "").strip().splitlines()[0]
        out += [f"## {name}", "", doc, "", "```", plan_tree(QUERIES[name](spark, sf)), "```", ""]
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
