"""Stream = batch on the small tables."""

from gatewatch.plans.registry import all_queries
from gatewatch.testing import compare, duck

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    qs = all_queries()
    con = duck(SF)
    for name in ["stream_hourly", "stream_latch", "stream_blocklist", "stream_signals"]:
        pdf = qs[name].build(spark, SF).toPandas()
        assert compare(pdf, con.sql(qs[name].sql).df()) == [], name


def test_multi_batch_respond_and_hourly(spark, tmp_path):
    """Four files, one per micro-batch: the running top-per-day and the
    hourly windows end equal to the batch answers."""
    from pyspark.sql import functions as F
    from gatewatch.operators import dashboards as D
    from gatewatch.sources.adapters import scored_events, waf_logs
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    for i in range(4):
        part = ev.filter((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4))
        part.coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        src = next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet"))
        src.rename(tmp_path / f"events-{i}.parquet")
    stream = J.file_stream(spark, str(tmp_path), "events-*.parquet", max_files=1)
    _, alerts = J.respond(spark, stream)
    got = sorted((r["day_key"], r["ip"], r["count"]) for r in alerts.collect())
    top = D.top_anomalous_ip_per_day(scored_events(ev))
    want = sorted((f"{r['year']}-{r['month']}-{r['day']}", r["ip"], r["cnt"]) for r in top.collect())
    assert got == want
    stream = J.file_stream(spark, str(tmp_path), "events-*.parquet", max_files=1)
    hourly = {(r["block_hour"], r["rule"]): r["cnt"] for r in J.hourly_counts(spark, stream).collect()}
    batch = {(r["block_hour"], r["rule"]): r["cnt"] for r in D.hourly_rule(waf_logs(ev)).collect()}
    assert hourly == batch


def test_multi_batch_latch(spark, tmp_path):
    """The stateful latch carries state across micro-batches: four time-ordered
    files give the same per-row latch as the batch scan."""
    from pyspark.sql import functions as F
    from gatewatch.operators import risk as RK
    from gatewatch.plans import q_windows as QW
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    for i in range(4):
        part = ev.filter((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4))
        part.coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        src = next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet"))
        src.rename(tmp_path / f"events-{i}.parquet")
    got = J.latch(spark, J.file_stream(spark, str(tmp_path), "events-*.parquet", max_files=1))
    got = sorted((r["row_id"], r["premit_on"], r["trigger"], r["mitigation_level"]) for r in got.collect())
    c = QW._clocked(spark, SF)
    want = RK.premitigation(c, ["ip"], ["event_ts", "row_id"], None)
    want = sorted((r["row_id"], r["premit_on"], r["trigger"], r["mitigation_level"]) for r in want.collect())
    assert got == want


def test_latch_replays_a_batch(spark, tmp_path):
    """A batch replayed after a crash before its commit starts from the state
    before it: the same rows come out."""
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        ev.filter((ev.event_id >= i * n // 2) & (ev.event_id < (i + 1) * n // 2)).coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet")).rename(src / f"events-{i}.parquet")
    root = tmp_path / "job"

    def run():
        return sorted(map(str, J.latch(spark, J.file_stream(spark, str(src), "events-*.parquet", max_files=1), root=str(root)).collect()))

    first = run()
    commits = sorted((p for p in root.rglob("commits/*") if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert len(first) == n and run() == first


def test_resume_processes_new_files_once(spark, tmp_path):
    """With a stable root, a second run picks up only the new file and the
    block list keeps its earlier entries (insert-if-absent across runs)."""
    from pyspark.sql import functions as F
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    src = tmp_path / "in"
    src.mkdir()
    for i, (lo, hi) in enumerate([(0, n // 2), (n // 2, n)]):
        part = ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi))
        part.coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        f = next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet"))
        if i == 0:
            f.rename(src / "events-0.parquet")
        else:
            late = f
    root = str(tmp_path / "job")
    b1, _ = J.respond(spark, J.file_stream(spark, str(src), "events-*.parquet"), root=root)
    first = {r["cidr"] for r in b1.collect()}
    late.rename(src / "events-1.parquet")
    b2, alerts = J.respond(spark, J.file_stream(spark, str(src), "events-*.parquet"), root=root)
    second = {r["cidr"] for r in b2.collect()}
    assert first <= second
    import os
    assert len([d for d in os.listdir(os.path.join(root, "out", "top")) if d.startswith("batch_id=")]) == 2


def test_respond_replays_a_batch(spark, tmp_path):
    """A crash between the sink and the commit replays the batch: the same
    block list and alerts come out."""
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        ev.filter((ev.event_id >= i * n // 2) & (ev.event_id < (i + 1) * n // 2)).coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet")).rename(src / f"events-{i}.parquet")
    root = tmp_path / "job"

    def run():
        block, alerts = J.respond(spark, J.file_stream(spark, str(src), "events-*.parquet", max_files=1), root=str(root))
        return sorted(map(str, block.collect())), sorted(map(str, alerts.collect()))

    first = run()
    commits = sorted((p for p in root.rglob("commits/*") if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) == 2
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == first
