"""Readers and writers of files of calls."""

import json

from callatlas.operators import transcripts as S
from callatlas.sources import readers


def test_transcripts_elements_and_truth_are_read_by_file(spark, tmp_path):
    (tmp_path / "t").mkdir()
    doc = {"language": "de", "segments": [{"start": 0.0, "end": 2.0, "text": " Klicken Sie hier. ", "speaker": "S1", "words": [{"word": "Klicken", "start": 0.1, "end": 0.4, "score": 0.8}, {"word": "Sie"}, {"word": "hier.", "start": 1.0, "end": 1.2}]}]}
    (tmp_path / "t" / "call_7.json").write_text(json.dumps(doc))
    (tmp_path / "t" / "call_8.json").write_text(json.dumps({"language": "en"}))
    t = readers.transcripts(spark, str(tmp_path / "t"))
    assert {(r["call_id"], r["language"], len(r["segments"])) for r in t.collect()} == {("call_7", "de", 1), ("call_8", "en", 0)}
    words = S.words_of(S.segments(t)).orderBy("word_idx").collect()
    assert [(w["word"], w["speaker"]) for w in words] == [("Klicken", "S1"), ("Sie", "S1"), ("hier.", "S1")] and words[1]["start_s"] == 2.0 / 3

    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "c.json").write_text(json.dumps({"elements": [{"bbox": [1, 2, 30, 40], "text": "OK", "class": "button"}, {"bbox": [1, 2, 3]}]}))
    got = readers.ui_elements(spark, str(tmp_path / "u")).collect()
    assert [(r["call_id"], r["det_seq"], r["x2"], r["text"], r["text_confidence"], r["class"]) for r in got] == [("c", 0, 30, "OK", 0.0, "button")]

    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.json").write_text(json.dumps({"video_id": "v", "events": [{"action_utterance": "klick", "utterance_start_s": 1.0, "event_time_s": 1.5, "event_type": "click", "observable": True}]}))
    assert [(r["call_id"], r["gt_idx"], r["event_time_s"], r["point"]) for r in readers.ground_truth(spark, str(tmp_path / "g")).collect()] == [("v", 0, 1.5, None)]


def test_graphs_are_written_by_call_and_read_back(spark, tmp_path):
    graph = lambda n: json.dumps({"schema_version": "1.0", "events": [{"event_id": f"event_{k:04d}", "type": "click"} for k in range(n)], "unbound_audio_references": []})
    out = str(tmp_path / "graphs")
    readers.write_documents(spark.createDataFrame([(1, graph(2)), (2, graph(1))], "call_id long, document string"), out)
    readers.write_documents(spark.createDataFrame([(2, graph(3))], "call_id long, document string"), out)  # replaces call 2 only
    for call, n in ((1, 2), (2, 3)):
        assert [len(r["events"]) for r in readers.event_graphs(spark, f"{out}/call_id={call}").collect()] == [n]


def test_packages_replace_their_own_call(spark, tmp_path):
    out = str(tmp_path / "p")
    rows = lambda *r: spark.createDataFrame(list(r), "call_id long, path string, content binary")
    readers.write_package(rows((1, "a/article.md", b"one"), (1, "a/images/step-01.jpg", b"\xff"), (2, "b/article.md", b"two")), out)
    readers.write_package(rows((1, "a/article.md", b"new")), out)
    got = {(r["call_id"], r["path"], bytes(r["content"])) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a/article.md", b"new"), (2, "b/article.md", b"two")}
