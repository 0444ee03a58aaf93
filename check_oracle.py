"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

usage: python check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

from gatewatch.plans.registry import all_queries
from gatewatch.session import get_spark
from gatewatch.testing import compare, duck


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark()
    con = duck(sf_dir)
    qs = all_queries()
    failed = []
    for name, q in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            pdf = q.build(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            failed.append(name)
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"ROWS {name}: {len(pdf)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            opdf = con.sql(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            failed.append(name)
            continue
        probs = compare(pdf, opdf)
        if probs:
            failed.append(name)
            print(f"FAIL {name} ({ts:.1f}s): " + " | ".join(probs))
        else:
            print(f"OK   {name}: {len(pdf)} rows ({ts:.1f}s)")
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
