"""Forward as-of joins and lag summaries against brute force."""
import datetime as dt
import random

from pyspark.sql import functions as F

from gatewatch.operators import incidents as I

T0 = dt.datetime(2024, 1, 1)


def test_next_event_against_brute_force(spark):
    rng = random.Random(2)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(5000))
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    starts = [(k, key(), at()) for k in range(300)] + [(300, "a", None), (301, "none", at()), (302, "hot", T0)] * 2
    events = [(key(), at()) for _ in range(400)] + [("hot", T0), ("a", None)]
    sdf = spark.createDataFrame([(*s, "x") for s in starts], "id int, k string, at timestamp, ts string")
    edf = spark.createDataFrame(events, "k string, ts timestamp")
    for horizon in (None, 60):
        got = I.next_event(sdf, edf, "k", "at", "ts", "found", horizon)
        assert got.columns == ["id", "k", "at", "ts", "found"]
        want = []
        for i, k, a in starts:
            later = [t for e, t in events if e is not None and e == k and t is not None and a is not None and t >= a]
            hit = min(later) if later else None
            want.append((i, None if hit is None or horizon is not None and (hit - a).total_seconds() > horizon else hit))
        assert sorted(map(str, want)) == sorted(str((r["id"], r["found"])) for r in got.collect())
    assert I.next_event(sdf.limit(0), edf, "k", "at", "ts", "found").count() == 0
    assert I.next_event(sdf, edf.limit(0), "k", "at", "ts", "found").where("found IS NOT NULL").count() == 0


def test_lag_summary(spark):
    s = lambda x: None if x is None else T0 + dt.timedelta(seconds=x)
    rows = [("a", s(0), s(10), s(40)), ("a", s(0), s(20), None), ("a", s(0), None, None), ("b", s(5), s(5), s(5))]
    df = spark.createDataFrame(rows, "g string, st timestamp, de timestamp, an timestamp")
    got = {r["g"]: tuple(r)[1:] for r in I.lag_summary(df, F.col("g"), "st", "de", "an").collect()}
    assert got == {"a": (3, 2, 1, 15.0, 20.0, 30.0, 30.0), "b": (1, 1, 1, 0.0, 0.0, 0.0, 0.0)}
