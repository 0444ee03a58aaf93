"""Versioned sets, keyed state and the event-time latch."""
import threading

import pytest
from pyspark.sql import functions as F

from gatewatch.operators.versioned import VersionedSet, create_new
from gatewatch.streaming.state import KeyedState, batch_ids

SF = "/root/testdata/sf0.001"
SCHEMA = "cidr string, first_seen timestamp_ntz, hits long"


def _rows(spark, keys, hits=1):
    return spark.createDataFrame([(k, hits) for k in keys], "cidr string, hits long").withColumn("first_seen", F.lit("2024-01-01").cast("timestamp_ntz"))


def _set(spark, path, **args):
    return VersionedSet(spark, str(path), "cidr", SCHEMA, **args)


def test_create_new_has_one_winner(spark, tmp_path):
    assert create_new(spark, str(tmp_path / "m" / "1"), "a") and not create_new(spark, str(tmp_path / "m" / "1"), "b")
    assert (tmp_path / "m" / "1").read_text() == "a"


def test_insert_if_absent_versions_and_replay(spark, tmp_path):
    s = _set(spark, tmp_path)
    assert s.latest() == 0 and s.read().count() == 0
    assert s.append_absent(_rows(spark, ["a", "b", "b", None]), ("job", 0)) == 1
    assert s.append_absent(_rows(spark, ["b", "c"], 2), ("job", 1)) == 2
    assert s.append_absent(_rows(spark, ["x"], 2), ("job", 1)) == 2  # replayed
    assert s.append_absent(_rows(spark, []), ("job", 2)) == 3
    assert sorted((r["cidr"], r["hits"]) for r in s.read().collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(r["cidr"] for r in s.read(1).collect()) == ["a", "b"]
    assert s.compact() and len(s.manifest(s.latest())["parts"]) == 1 and s.read().count() == 3
    assert s.vacuum(keep=1, older_than_s=-1) == 3 and s.read().count() == 3
    assert s.append_absent(_rows(spark, ["z"]), ("job", 2)) == s.latest()  # the transaction outlives compaction
    assert s.read().count() == 3


def test_a_second_writer_loses_nothing(spark, tmp_path, monkeypatch):
    """Another commit comes in between the read and the commit."""
    s, other = _set(spark, tmp_path), _set(spark, tmp_path)
    s.append_absent(_rows(spark, ["a"]))
    real, calls = VersionedSet._commit, []

    def commit(self, version, parts, done):
        calls.append(version)
        if len(calls) == 1:
            real(other, version, other.manifest(version - 1)["parts"] + [other._write(_rows(spark, ["b", "c"], 7))], {})
        return real(self, version, parts, done)
    monkeypatch.setattr(VersionedSet, "_commit", commit)
    assert s.append_absent(_rows(spark, ["a", "b", "d"], 9)) == 3 and calls == [2, 3]
    assert sorted((r["cidr"], r["hits"]) for r in s.read().collect()) == [("a", 1), ("b", 7), ("c", 7), ("d", 9)]


def test_writers_at_once(spark, tmp_path):
    errors = []

    def write(k):
        try:
            s = _set(spark, tmp_path, compact_after=3)
            for j in range(3):
                s.append_absent(_rows(spark, [f"w{k}-{j}", f"shared-{j}"], k))
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = sorted(r["cidr"] for r in _set(spark, tmp_path).read().collect())
    assert got == sorted([f"w{k}-{j}" for k in range(3) for j in range(3)] + [f"shared-{j}" for j in range(3)])


def test_keyed_state_compacts_and_replays(spark, tmp_path):
    st = KeyedState(spark, str(tmp_path), ["k"], "k string, v int", every=3)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    want = {}
    for b in range(8):
        rows = {f"k{b % 4}": b, "every": b}
        before = {r["k"]: r["v"] for r in st.read(b).collect()}
        assert before == want
        for _ in range(2):  # a replay overwrites
            st.write(frame(list(rows.items())), b)
            assert {r["k"]: r["v"] for r in st.read(b).collect()} == want
        want |= rows
    assert {r["k"]: r["v"] for r in st.read().collect()} == want
    assert batch_ids(spark, st.full) == [2, 5] and batch_ids(spark, st.delta) == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("days, late", [(400, 0), (0, None)])
def test_shuffled_files_give_the_batch_latch(spark, tmp_path, days, late):
    """Files in any order, one per micro-batch: within the delay the result is
    the batch latch; without a delay, rows that came too late are set aside and
    the others get the batch latch over themselves."""
    from gatewatch.operators import risk as RK
    from gatewatch.plans import q_windows as QW
    from gatewatch.streaming import jobs as J
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    src = tmp_path / "in"
    src.mkdir()
    for i, j in enumerate([2, 0, 3, 1]):
        part = ev.where((F.col("event_id") >= j * n // 4) & (F.col("event_id") < (j + 1) * n // 4))
        part.coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        next(p for p in (tmp_path / f"stage{i}").iterdir() if p.name.endswith(".parquet")).rename(src / f"events-{i}.parquet")
    root = str(tmp_path / "job")
    got = J.latch(spark, J.file_stream(spark, str(src), "events-*.parquet", max_files=1), root=root, delay=f"{days} days")
    got = sorted((r["row_id"], r["premit_on"], r["trigger"], r["mitigation_level"]) for r in got.collect())
    aside = {r["row_id"] for r in J.late_rows(spark, root).collect()}
    assert len(got) + len(aside) == n and (len(aside) == late if late is not None else n // 4 < len(aside) < n)
    c = QW._clocked(spark, SF).where(~F.col("row_id").isin(list(aside)))
    want = RK.premitigation(c, ["ip"], ["event_ts", "row_id"], None)
    assert got == sorted((r["row_id"], r["premit_on"], r["trigger"], r["mitigation_level"]) for r in want.collect())
