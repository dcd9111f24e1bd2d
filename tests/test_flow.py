"""Files of calls, under names that are text, through to files of event graphs."""

import json
import re

import pytest

from callatlas.operators import targets
from callatlas.plans import flow
from callatlas.sources import readers

EVENTS = (
    "call_id string, vis_seq long, action string, time_s double, start_s double, end_s double, x int, y int, point_source string, detector_confidence double, state_change_confidence double, "
    "ui_interactive_confidence double, evidence array<struct<source:string,confidence:double>>"
)


def said(*phrases):
    """A transcript with a segment a phrase: (start, text)."""
    out = []
    for start, text in phrases:
        words = [{"word": w, "start": start + 0.3 * k, "end": start + 0.3 * k + 0.25, "score": 0.9} for k, w in enumerate(text.split())]
        out.append({"start": start, "end": words[-1]["end"], "text": text, "speaker": "A", "words": words})
    return {"language": "de", "segments": out}


def test_files_become_graphs(spark, tmp_path):
    for folder in ("t", "u"):
        (tmp_path / folder).mkdir()
    (tmp_path / "t" / "call-a.json").write_text(json.dumps(said((10.0, "Klicken Sie hier."), (30.0, "Klicken Sie auf Speichern."), (60.0, "Danke schön."))))
    (tmp_path / "t" / "call-b.json").write_text(json.dumps(said((5.0, "Hier klicken und dann dort ziehen."))))
    (tmp_path / "t" / "broken.json").write_text("{no json")
    (tmp_path / "u" / "call-a.json").write_text(json.dumps({"elements": [{"bbox": [100, 100, 200, 140], "text": "Speichern", "text_confidence": 0.9, "interactive_confidence": 0.8, "class": "button"}]}))
    e = [("call-a", 1, "click", 10.9, 10.8, 11.0, 150, 120, "cursor", 0.9, 0.8, 0.7, [("cursor", 0.9)]), ("call-a", 2, "click", 31.2, 31.1, 31.3, 150, 120, "cursor", 0.9, 0.8, 0.7, [("cursor", 0.9)]), ("call-b", 1, "click", 5.6, 5.5, 5.7, 5, 5, "cursor", 0.9, 0.8, 0.7, [("cursor", 0.9)])]
    events = spark.createDataFrame(e, EVENTS)
    out = f"{tmp_path}/out"
    flow.from_files(events, f"{tmp_path}/t", f"{tmp_path}/u", out)
    a = readers.event_graphs(spark, f"{out}/call_id=call-a").first()
    b = readers.event_graphs(spark, f"{out}/call_id=call-b").first()
    assert [(x["type"], x["audio_references"][0]["transcript"], x["target"]["text"]) for x in a["events"]] == [("click", "Klicken Sie hier.", "Speichern"), ("click", "Klicken Sie auf Speichern.", "Speichern")]
    assert [x["audio_references"][0]["transcript"] for x in b["events"]] == ["Hier klicken und"] and b["events"][0]["target"] is None
    assert [x["transcript"] for x in b["unbound_audio_references"]] == ["dort ziehen."]
    assert [r["file_name"] for r in readers.malformed(spark, f"{tmp_path}/t", "language string").collect()] == ["broken"]


@pytest.fixture
def plain_plans(spark):
    """Joins without broadcast and plans as they are before they run."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def exchanges(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_tables_in_buckets_meet_without_an_exchange(spark, plain_plans):
    """The same graphs from tables in buckets by call; none of the joins after matching deals rows anew."""
    d = "/root/testdata/sf0.001"
    from callatlas.plans import core
    from callatlas.sources import fixtures as X

    docs, events, elements = X.transcripts(spark, d), core.events(spark, d), X.derived(spark, d, "elements")
    told, alone = flow.event_graphs(docs, events, elements)
    names = [f"flow_test_{n}" for n in ("events", "elements", "references", "bound")]
    try:
        e, s = flow.by_call(events, names[0], 4), flow.by_call(elements, names[1], 4)
        met, left = flow.event_graphs(docs, e, s, keep=flow.tables("flow_test", 4))
        assert exchanges(targets.targets_at_points(e, s)) == 0 < exchanges(targets.targets_at_points(events, elements))
        assert exchanges(met) == exchanges(left) == 0 < exchanges(told)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(met) == rows(told) and rows(left) == rows(alone) and len(rows(met)) > 50
    finally:
        for n in names:
            spark.sql(f"drop table if exists {n}")
