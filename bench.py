"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query's plan is executed in full with the ``noop`` sink (no collect to
the driver). ``scoring_ms_per_row`` times the forest's Arrow scoring pass
alone over the log table (the published figure to compare with is 0.016 ms per row).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from gatewatch.plans.registry import all_queries
from gatewatch.session import get_spark


def run(df):
    df.write.format("noop").mode("overwrite").save()


def scoring_latency(spark, sf_dir: str) -> float:
    from gatewatch.operators import forest as FR
    from gatewatch.operators.features import TRAIN_FEATURES
    from gatewatch.plans.q_model import _waf_training
    df = _waf_training(spark, sf_dir).cache()
    n = df.count()
    scaled, _ = FR.standardize(df, TRAIN_FEATURES)
    hp = FR.safe_hyperparams(n)
    forest = FR.fit(scaled, TRAIN_FEATURES, n_trees=hp["n_estimators"], max_samples=hp["max_samples"],
                    max_features=hp["max_features"], n_rows=n)
    pdf = FR.collect_nodes(forest)
    scored = FR.score(scaled, forest, nodes_pdf=pdf)
    run(scored.select("score"))  # warm
    t0 = time.time()
    run(scored.select("score"))
    dt = time.time() - t0
    df.unpersist()
    return dt * 1000.0 / max(n, 1)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = all_queries()
    # warm-up (not timed): JVM / codegen, and the Python workers of the Arrow UDFs
    run(qs["rule_blocks"].build(spark, sf_dir))
    run(qs["golden_forest_score"].build(spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")))
    times, errors = {}, {}
    for name, q in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            run(q.build(spark, sf_dir))
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {times.get(name, 'error')}", file=sys.stderr, flush=True)
    extra = {}
    if not only:
        extra["scoring_ms_per_row"] = round(scoring_latency(spark, sf_dir), 5)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus), "n_queries": len(times), **extra}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
