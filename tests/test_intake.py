"""Branches of the intake, edge and analysis queries; late rows of a stream."""

import datetime as dt

from pyspark.sql import functions as F

from gatewatch.operators import dashboards as D
from gatewatch.plans.q_intake import _delivered
from gatewatch.plans.registry import all_queries
from gatewatch.sources import waflogs as WL
from gatewatch.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_edge_decision_reaches_every_outcome(spark):
    df = all_queries()["edge_decision"].build(spark, SF)
    for mode in ("action_offset", "action_fixed"):
        assert {r[0] for r in df.select(mode).distinct().collect()} == {"BLOCK", "ALLOW", "FAIL_OPEN"}


def test_analysis_flags_and_classifies(spark):
    lines = {(r["sec"], r["ln"]): r["value"] for r in all_queries()["model_analysis"].build(spark, SF).collect()}
    assert lines[(1, 1)].split()[0] in ("pass_through", "re_threshold")
    assert len([k for k in lines if k[0] == 3]) > 3 and len([k for k in lines if k[0] == 2]) == 9


def test_delivery_layout_and_projection(spark):
    out = _delivered(spark, SF)
    day = WL.read_json_logs(spark, WL.projected_glob(out, ["2024"], ["01"], ["05"], WL.projected_values("integer", (0, 23))))
    ev = spark.read.parquet(f"{SF}/events.parquet").filter(F.to_date("ts") == F.lit("2024-01-05"))
    assert day.count() == ev.count()
    assert {r[0] for r in day.select("day").distinct().collect()} == {"05"}
    assert WL.valid_logs(day).count() == ev.filter("event_id % 13 <> 0").count()


def test_daily_report_without_data(spark):
    sc = spark.createDataFrame([("1.1.1.1", 1, "2026", "05", "01")], "ip string, anomaly int, year string, month string, day string")
    ok = D.daily_report(sc, dt.date(2026, 5, 1)).first()
    none = D.daily_report(sc, dt.date(2026, 5, 2)).first()
    assert (ok["status"], ok["ip"], ok["cnt"]) == ("ok", "1.1.1.1", 1)
    assert (none["status"], none["ip"], none["run_day"]) == ("no_data", None, "2026-05-02")


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark, arriving two batches later, is not counted."""
    src, root = str(tmp_path / "in"), str(tmp_path / "job")

    def put(i, hour, minute):
        row = (i, 1, "error", dt.datetime(2026, 5, 1, hour, minute), 80.0, "{}")
        spark.createDataFrame([row], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string") \
            .coalesce(1).write.mode("append").parquet(src)

    def run():
        return {r["block_hour"]: r["cnt"] for r in J.hourly_counts(
            spark, J.file_stream(spark, src, "*.parquet", schema=spark.read.parquet(src).schema), root=root).collect()}

    put(1, 5, 30)
    run()
    put(2, 9, 30)
    run()
    put(3, 5, 40)   # 05:00 closed at 06:00; the watermark is 09:20
    put(4, 9, 25)
    assert run() == {"2026-05-01 05:00:00": 1, "2026-05-01 09:00:00": 2}
