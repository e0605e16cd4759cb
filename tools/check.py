"""Compare registered queries with their oracles: check.py [sf] [name ...]."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import difference, spark_rows  # noqa: E402
from leadloom.plans import load  # noqa: E402
from leadloom.session import build_session  # noqa: E402


def main():
    scale, names = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, found in load().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = found(spark, folder)
            if found.oracle:
                problem = difference(df, found.oracle, folder)
                outcome = "ok" if problem is None else f"DIFF {problem}"
            else:
                outcome = f"rows {len(spark_rows(df)[1])}"
        except Exception as error:  # noqa: BLE001 - reported, then the next query
            outcome = "ERROR " + str(error)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += outcome.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    print("problems:", bad)


main()
