"""Queries see whole calls: late events, far ids, many clicks."""

import datetime

import pytest

import __spark_entry__ as entry
from callatlas.plans import core, media


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        """rows: event_id, user_id, event_type, second of the call."""
        start = datetime.datetime(2024, 1, 1)
        at = [(i, u, k, start + datetime.timedelta(microseconds=round(s * 2e10))) for i, u, k, s in rows]
        spark.createDataFrame(at, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return make


def test_frames_and_windows_reach_the_end_of_the_call(spark, folder):
    d = folder([(1, 1, "click", 1.0), (2, 1, "click", 100.1), (3, 2, "click", 50.0), (4, 3, "view", 125.0), (5, 3, "view", 126.0)])
    last = {r["call_id"]: r["k"] for r in media.frames(spark, d).groupBy("call_id").agg({"frame_idx": "max"}).toDF("call_id", "k").collect()}
    assert last == {1: 404, 2: 204, 3: 508}
    q = entry.queries()
    lower = [(r["call_id"], r["time_s"]) for r in q["frame_differences"](spark, d).where("y2 > 24 and fraction >= 0.1").collect()]
    assert sorted(lower) == [(1, 1.0), (1, 100.25), (2, 50.0)]
    assert {r["call_id"] for r in q["settled_screenshots"](spark, d).collect()} == {1, 2}
    assert [(r["call_id"], r["from_s"], r["to_s"]) for r in q["analysis_windows"](spark, d).collect()] == [(3, 123.5, 127.0)]


def test_boxes_overlap_whatever_their_ids(spark, folder):
    rows = [(8, 1, "click", 20.0), (100708, 1, "click", 20.5), (201408, 1, "click", 90.0), (100709, 1, "click", 20.5), (302108, 2, "click", 20.0)]
    rows += [(1000 + k, 3, "click", 9.0 + k / 7) for k in range(150)] + [(1000 + k * 1900 * 53 + k % 3, 3, "click", 9.0 + k / 3) for k in range(1, 60)]
    d = folder(rows)
    e = {r["element_seq"]: r for r in core.X.derived(spark, d, "elements").collect()}
    cross = lambda a, b, low, high: min(a[high], b[high]) - max(a[low], b[low])
    want = [(i, j) for i, a in e.items() for j, b in e.items() if i < j and a["call_id"] == b["call_id"] and cross(a, b, "x1", "x2") > 0 and cross(a, b, "y1", "y2") > 0 and cross(a, b, "first_seen_s", "last_seen_s") >= 0]
    got = [(r["left_seq"], r["right_seq"]) for r in entry.queries()["box_overlaps"](spark, d).collect()]
    assert sorted(got) == sorted(want) and (8, 100708) in got and len(got) > 20


def test_forty_actions_of_a_call_are_told(spark, folder):
    ids = [i for i in range(1, 200) if i % 7 and i % 5 in (0, 1, 3, 4)][:45]
    d = folder([(i, 1, "click", 2.0 * k) for k, i in enumerate(ids)])
    assert entry.queries()["observed_actions"](spark, d).count() == 40
