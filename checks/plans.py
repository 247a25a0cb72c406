"""What the final plan of each query does with the tables.

    python -m checks.plans [folder] [query ...]

Prints per query the scans of each large table, the exchanges, the reuses and
the nodes that should not be there: products and scans of unneeded columns.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from checks.registry import all_queries
from paylens.session import configure

_TABLES = ("lineitem", "orders", "customer", "part", "supplier")


def final_plan(df: DataFrame) -> str:
    """The physical plan after the query has run, without the initial one."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.split(r"\+- == Initial Plan ==", text)[0]


def profile(plan: str) -> Counter:
    found: Counter = Counter()
    for line in plan.splitlines():
        if "ReusedExchange" in line:
            found["reused"] += 1
        elif "FileScan" in line:
            table = next((t for t in _TABLES if f"/{t}.parquet" in line), None)
            if table:
                found[f"scan {table}"] += 1
        elif re.search(r"[ :+-]Exchange ", line):
            found["single" if "SinglePartition" in line else "shuffle"] += 1
        elif re.search(r"CartesianProduct|BroadcastNestedLoopJoin", line):
            found["PRODUCT"] += 1
        elif "SortMergeJoin" in line:
            found["merge join"] += 1
        elif "BroadcastHashJoin" in line:
            found["broadcast join"] += 1
    return found


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark = configure(
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.sql.debug.maxToStringFields", "1000")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        found = profile(final_plan(all_queries()[name](spark, folder)))
        print(f"{name:34s}", ", ".join(f"{k} {v}" for k, v in sorted(found.items())), flush=True)


if __name__ == "__main__":
    main()
