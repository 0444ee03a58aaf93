"""gatewatch — Spark-native analytics for web-security request logs.

Layout:
  sources/    readers and writers (WAF JSON logs, scored events, CSV, reports,
              model tables) plus adapters that present the test tables in the
              log schemas the operators expect
  functions/  column functions (entropy, text features, codes, risk mapping)
  operators/  DataFrame operators (dashboards, policy replay, statistics,
              windows and scans, isolation forest, evaluation, federation)
  plans/      the query catalogue: one Spark plan + one oracle SQL per query
  streaming/  Structured Streaming jobs (hourly counts, latch, block list,
              live scoring)
"""

from gatewatch.session import get_spark, checkpoint_dir  # noqa: F401
