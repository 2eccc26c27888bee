"""Print the operator outline of registered queries' physical plans.

Usage: python tools/show_plans.py [sf_dir] name [name ...]
Shows scans (pruned schema, pushed filters), exchanges, joins, aggregates,
generators and Python nodes, which is what the scale review looks at.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracelens.plans import registry  # noqa: E402
from tracelens.session import local_session  # noqa: E402

KEEP = ("Exchange", "FileScan", "Join", "Aggregate", "Generate", "Window", "MapInPandas", "Scan ExistingRDD", "Union", "Sort ")


def outline(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: \S+ \[[^\]]*\]", "", line)
            out.append(line[:220])
    return out


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    spark = local_session(8)
    qs = registry.queries()
    for name in args:
        df = qs[name](spark, sf)
        print(f"### {name}\n```")
        print("\n".join(outline(df._jdf.queryExecution().executedPlan().toString())))
        print("```\n")


if __name__ == "__main__":
    main()
