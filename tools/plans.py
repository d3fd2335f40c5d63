"""Look at the physical plan of each query: size of generated methods, joins, exchanges, pushed columns.

    python tools/plans.py <sf_dir> [name prefix ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabcascade.bindings import REGISTRY  # noqa: E402
from tabcascade.session import build_session  # noqa: E402

JIT_LIMIT = 8000
SUSPECT = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition")


def explained(spark, df, mode: str) -> str:
    kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def main() -> None:
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("plans", f"local[{os.cpu_count()}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Generated code shows up only once the adaptive plan is final.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for name, bound in REGISTRY.items():
        if bound.sql is None or (prefixes and not name.startswith(prefixes)):
            continue
        df = bound.run(spark, folder)
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explained(spark, df, "codegen"))]
        plan = explained(spark, df, "simple")
        notes = [f"{s} x{plan.count(s)}" for s in SUSPECT if s in plan]
        largest = max(sizes, default=0)
        flag = "  TOO LARGE TO COMPILE" if largest > JIT_LIMIT else ""
        print(f"{name:32s} method {largest:6d}  exchanges {plan.count('Exchange hashpartitioning'):2d}  {', '.join(notes)}{flag}", flush=True)


if __name__ == "__main__":
    main()
