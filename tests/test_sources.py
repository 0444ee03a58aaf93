"""Sources and sinks: WAF JSON logs, path partitions, projection, reports, CSV."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from gatewatch.sources import files as FS
from gatewatch.sources import projection as PJ
from gatewatch.sources import waflogs as WL


def _record(ts, rule, action, ip, country):
    return {"timestamp": ts, "formatversion": 1, "webaclid": "acl", "terminatingruleid": rule,
            "terminatingruletype": "REGULAR", "action": action, "httpsourcename": "ALB", "httpsourceid": "x",
            "httprequest": {"clientip": ip, "country": country, "uri": "/a", "args": "", "httpmethod": "GET",
                            "httpversion": "HTTP/1.1", "headers": [{"name": "Host", "value": "h"}]},
            "rulegrouplist": [], "labels": [{"name": "l"}]}


def test_waf_json_malformed_and_path_partitions(spark, tmp_path):
    root = tmp_path / "logs"
    for hour in ("05", "06"):
        d = root / "2026" / "05" / "01" / hour
        d.mkdir(parents=True)
        with open(d / "part.json", "w") as f:
            f.write(json.dumps(_record(1777600000000, "GeoBlock-Non-KR", "BLOCK", "1.2.3.4", "US")) + "\n")
            f.write("{not json\n")
    df = WL.read_json_logs(spark, str(root) + "/*/*/*/*/")
    c = WL.count_malformed(df).first()
    assert c["rows"] == 4 and c["malformed"] == 2
    good = WL.valid_logs(df)
    assert sorted(r["hour"] for r in good.collect()) == ["05", "06"]
    assert good.select("month").distinct().first()["month"] == "05"
    glob = WL.projected_glob(str(root), ["2026"], WL.projected_values("enum", ["05"]),
                             WL.projected_values("integer", (1, 31)), WL.projected_values("integer", (6, 6)))
    only6 = WL.valid_logs(WL.read_json_logs(spark, glob))
    assert [r["hour"] for r in only6.collect()] == ["06"]


def test_landed_partitions_stay_strings(spark, tmp_path):
    from gatewatch.sources.adapters import waf_logs
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    w = waf_logs(ev).drop("row_id", "event_ts")
    out = str(tmp_path / "landed")
    WL.land(w, out)
    back = WL.read_landed(spark, out)
    assert dict(back.dtypes)["month"] == "string"
    assert back.filter(F.col("month") == "01").count() == ev.count()
    plan = back.filter(F.col("day") == "05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_scan_report_flatten(spark, tmp_path):
    findings = [{"rule_id": f"r{i}", "severity": sev, "description": "d", "links": [f"https://x/{i}"],
                 "status": 0, "location": {"filename": "main.tf", "start_line": i, "end_line": i + 1}}
                for i, sev in enumerate(["CRITICAL"] * 4 + ["HIGH"] * 10 + ["MEDIUM"] + ["LOW"] * 8)]
    p = tmp_path / "scan.json"
    p.write_text(json.dumps({"results": findings}, indent=2))
    flat = FS.flatten_findings(spark, str(p))
    assert flat.columns == FS.FINDINGS_FLAT_COLUMNS
    got = {r["severity"]: r["findings"] for r in FS.severity_rollup(flat).collect()}
    assert got == {"CRITICAL": 4, "HIGH": 10, "MEDIUM": 1, "LOW": 8}


def test_csv_and_metrics_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("00:01.5", "1.1.1.1", "KR", "/a", "GeoBlock-Non-KR", None, 0, 1, 2)],
                               FS.WAF_FLAT_SCHEMA)
    FS.write_csv(df, str(tmp_path / "c"))
    back = FS.read_csv(spark, str(tmp_path / "c"), FS.WAF_FLAT_SCHEMA).first()
    assert back["action"] is None and back["uri_len"] == 2
    m = spark.createDataFrame([(1, 0.5, [1, 2])], "n long, p double, arr array<int>")
    FS.write_metrics(m, str(tmp_path / "m"), flat=True)
    assert FS.read_metrics(spark, str(tmp_path / "m")).columns == ["n", "p"]


def test_api_access_logs(spark, tmp_path):
    p = tmp_path / "api.json"
    p.write_text('{"requestId": "r1", "ip": "1.2.3.4", "requestTime": "02/Dec/2026:10:00:00 +0000", '
                 '"httpMethod": "GET", "resourcePath": "/predict", "status": "200", "protocol": "HTTP/1.1", '
                 '"responseLength": "42"}\n{broken\n')
    df = FS.read_api_logs(spark, str(p))
    assert df.columns == [f.name for f in FS.API_LOG_SCHEMA.fields]
    rows = df.filter(F.col("requestId").isNotNull()).collect()
    assert len(rows) == 1 and rows[0]["status"] == "200"


def _folders(root, hours, days=("01", "02")):
    for day in days:
        for hour in hours:
            d = root / "2026" / "05" / day / hour
            d.mkdir(parents=True)
            good = json.dumps(_record(1777600000000, "GeoBlock-Non-KR", "BLOCK", "1.2.3.4", "US"))
            (d / "a.json").write_text(f"{good}\r\n{good[:150]}\n\n{good}")  # no line end at the end
            (d / "b.json").write_text("" if hour == "05" else f"{good}\n")
            (d / "_SUCCESS").write_text("no data\n")


def test_projection_source_counts_every_folder_and_pushes_key_filters(spark, tmp_path):
    _folders(tmp_path, ("05", "06", "23"))
    values = {"year": ["2026"], "month": (4, 6), "day": (1, 31), "hour": (0, 22)}  # hour 23 is not declared
    for root, splits in ((str(tmp_path), 1), (f"file://{tmp_path}/", 3)):
        logs = PJ.read_projected_logs(spark, root, values, splits=splits)
        got = {tuple(r) for r in WL.count_malformed(logs, WL.PARTITIONS).collect()}
        assert got == {("2026", "05", d, h, 3 + (h == "06"), 1) for d in ("01", "02") for h in ("05", "06")}
    one = logs.where("day = '02' AND hour IN ('05', '06', '23') AND hour >= '06' AND action = 'BLOCK'")
    assert [(r["day"], r["hour"], r["httprequest"]["clientip"]) for r in one.collect()] == [("02", "06", "1.2.3.4")] * 3
    cut = logs.where("_corrupt_record IS NOT NULL").first()
    assert cut["timestamp"] is None and cut["action"] is None and cut["_corrupt_record"].startswith('{"timestamp": 1777600000000')
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(day,02), In(hour, [05,06,23]), GreaterThanOrEqual(hour,06)]" in plan
    assert logs.where("day > '31'").count() == 0
    assert logs.where("hour = '23'").count() == 0


def test_projection_names_only_the_folders_that_filters_leave():
    options = {"path": "/nowhere", "year.enum": "2025,2026", "month.range": "1,12", "day.range": "1,31", "hour.range": "0,23"}
    r = PJ.ProjectedReader(options)
    assert sum(len(p.values) for p in r.partitions()) == 2 * 12 * 31 * 24
    assert max(len(p.values) for p in r.partitions()) == PJ.FOLDERS_PER_TASK
    unknown = EqualTo(("value",), "x")
    left = list(r.pushFilters([EqualTo(("year",), "2026"), In(("month",), ("02", "13")), LessThan(("day",), "03"), GreaterThan(("hour",), "20"), unknown]))
    assert left == [unknown]
    assert [v for p in r.partitions() for v in p.values] == [("2026", "02", d, h) for d in ("01", "02") for h in ("21", "22", "23")]
    assert list(r.pushFilters([EqualTo(("year",), "1999")])) == [] and [p.values for p in r.partitions()] == [[]]
    assert list(r.read(r.partitions()[0])) == []
    with pytest.raises(ValueError):
        PJ.ProjectedReader({"path": "/nowhere", "year.enum": "2025"})


def test_line_blocks_are_the_lines_whatever_the_block():
    text = "a\nbb\r\n\nlong line " * 7 + "\nend é"
    want = [x.rstrip("\r") for x in text.split("\n")]
    for size in (1, 2, 3, 7, 50, 10_000):
        assert [x for b in PJ.line_blocks(io.BytesIO(text.encode()), size) for x in b] == want
        assert [x for b in PJ.line_blocks(io.BytesIO(text.encode() + b"\n"), size) for x in b] == want
    assert list(PJ.line_blocks(io.BytesIO(b""))) == []
