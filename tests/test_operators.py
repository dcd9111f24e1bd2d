"""Order-dependent operators against plain loops, and literal cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callatlas.operators import articles as A
from callatlas.operators import clicks, fusion, targets
from callatlas.operators import describe as D
from callatlas.operators import evaluation as E
from callatlas.operators import frames as P
from callatlas.operators import model_steps as M
from callatlas.operators import transcripts as S
from callatlas.streaming import streams as Z

REF = "call_id long, ref_seq long, anchor_s double, start_s double, spoken_action string, explicit_target string, ordinal int"
EVENT = "call_id long, vis_seq long, time_s double, action string, x int, ui_interactive_confidence double, state_change_confidence double, detector_confidence double"


def test_reference_binds_to_the_near_click(spark):
    r = spark.createDataFrame([(1, 0, 12.58, 12.22, "click", None, 0)], REF)
    e = spark.createDataFrame([(1, k, t, "click", 5, 0.9, 0.9, 0.95) for k, t in enumerate((9.0, 12.71, 14.9))], EVENT)
    got = fusion.resolve(fusion.candidates(r, e)).collect()
    assert [(g["ref_seq"], g["vis_seq"]) for g in got] == [(0, 1)] and got[0]["score"] > 0.7


def test_one_start_keeps_spoken_order(spark):
    r = spark.createDataFrame([(1, 0, 1.2, 0.0, "click", None, 0), (1, 1, 1.0, 0.0, "click", None, 1)], REF)
    e = spark.createDataFrame([(1, 0, 1.0, "click", 5, 1.0, 1.0, 1.0), (1, 1, 1.3, "click", 5, 1.0, 1.0, 1.0)], EVENT)
    got = {g["ref_seq"]: g["vis_seq"] for g in fusion.resolve(fusion.candidates(r, e)).collect()}
    assert got in ({0: 0, 1: 1}, {1: 0}, {0: 1}, {0: 0}, {1: 1})
    assert not (got.get(0) == 1 and got.get(1) == 0)


def test_greedy_match_is_the_loop(spark):
    r = random.Random(2)
    rows = []
    for call in range(6):
        for ref in range(12):
            for vis in range(12):
                if r.random() < 0.4:
                    rows.append((call, ref, vis, round(r.choice([0.4, 0.5, 0.6, r.random()]), 3), float(ref // 3), ref % 3, float(vis), float(ref)))
    d = spark.createDataFrame(rows, "call_id long, ref_seq long, vis_seq long, score double, start_s double, ordinal int, time_s double, anchor_s double")
    want = set()
    for call in range(6):
        taken = []
        for _, ref, vis, _, start, o, t, _ in sorted((x for x in rows if x[0] == call), key=lambda x: (-x[3], x[1], x[2])):
            if any(ref == a or vis == b for a, b, *_ in taken):
                continue
            if any(s == start and o != p and ((t <= q) if o > p else (t >= q)) for _, _, s, p, q in taken):
                continue
            taken.append((ref, vis, start, o, t))
        want |= {(call, a, b) for a, b, *_ in taken}
    assert {(g["call_id"], g["ref_seq"], g["vis_seq"]) for g in fusion.resolve(d).collect()} == want


def test_status_by_source(spark):
    d = spark.createDataFrame([(True, "cursor_tracker"), (True, "sam2"), (True, "vlm_pointing"), (False, "telemetry"), (True, "paddleocr")], "p boolean, s string")
    assert [r[0] for r in d.select(fusion.grounding_status(F.col("p"), F.col("s"))).collect()] == ["observed", "tracked", "inferred", "unobservable", "inferred"]


def has_action(ws):
    return S.spoken_action(ws)


@pytest.mark.parametrize("text,parts", [("Hier klicken und dann dort ziehen.", ["Hier klicken und", "dort ziehen."]), ("Klicken Sie hier.", ["Klicken Sie hier."]), ("zuerst öffnen , dann klicken, next drag it", ["öffnen , klicken,", "drag it"]), ("then", [])])
def test_clauses(text, parts):
    ws = text.split(" ")
    assert [" ".join(ws[i] for i in c) for c in S.clauses(ws, has_action)] == parts


def test_glue_and_cuts(spark):
    rows = [(0.0, 1.0, "Your entire", "A"), (1.2, 2.0, "Screen right like so", "A"), (2.1, 3.0, "No.", "B"), (3.0, 4.0, "ab", "B"), (9.0, 9.5, "Late", "B")]
    p = spark.createDataFrame([(1, k, 0, *r) for k, r in enumerate(rows)], "call_id long, seg_idx int, piece int, start_s double, end_s double, text string, speaker string")
    assert [r["text"] for r in S.glued(p).orderBy("sent_no").collect()] == ["Your entire screen right like so", "No.", "Late"]
    assert S.cuts(3000, 1400, [(1100, 1101), (500, 503)])[0] == (0.0, 1100.5)
    assert S.cuts(100, 1400, []) == [(0.0, 100)]


def test_sentence_pieces_are_the_loop(spark):
    r = random.Random(4)
    rows = []
    for seg in range(30):
        for k in range(r.randrange(1, 120)):
            rows.append((1, seg, k, r.choice(["a", "b.", "3.", "c!", "d"]), float(k), k + 0.5, r.choice(["A", "A", "A", "B", None])))
    d = spark.createDataFrame(rows, "call_id long, seg_idx int, word_idx int, word string, start_s double, end_s double, speaker string")
    got = {(x["seg_idx"], x["piece"]): (x["raw"], x["speaker"]) for x in S.sentence_pieces(d).collect()}
    want = {}
    for seg in range(30):
        buf, out = [], []

        def flush(buf=buf, out=out):
            if buf:
                n = {}
                for w in buf:
                    if w[6] is not None:
                        n[w[6]] = n.get(w[6], 0) + 1
                out.append((" ".join(w[3] for w in buf), max(n, key=n.get) if n else None))
                buf.clear()

        for w in (x for x in rows if x[1] == seg):
            if buf and w[6] is not None and buf[-1][6] is not None and w[6] != buf[-1][6]:
                flush()
            buf.append(w)
            if (w[3][-1] in ".!?" and w[3] != "3.") or len(buf) >= 40:
                flush()
        flush()
        want |= {(seg, k): v for k, v in enumerate(out)}
    assert got == want


def test_detections_become_stable_elements(spark):
    rows = [(1, 1.0, 0, 100, 100, 200, 140, "Speichern", 0.9, 0.8, "button"), (1, 1.0, 1, 300, 100, 400, 140, "Abbrechen", 0.9, 0.8, "unknown"), (1, 2.0, 2, 102, 101, 202, 141, "Speichem", 0.6, 0.7, "button")]
    got = targets.stable_elements(spark.createDataFrame(rows, "call_id long, time_s double, det_seq long, x1 int, y1 int, x2 int, y2 int, text string, text_confidence double, interactive_confidence double, class string")).orderBy("element_seq").collect()
    assert [(g["text"], g["observations"]) for g in got] == [("Speichern", 2), ("Abbrechen", 1)] and got[0]["x1"] == round(100 + 0.3 * 2)


def test_state_changes_and_windows(spark):
    s = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.0, 0.01, 0.01, 0.0, 0.7])], "call_id long, k int, fraction double")
    assert [(r["k"], r["scene_cut"]) for r in clicks.state_changes(s, ["k"]).orderBy("k").collect()] == [(2, False), (4, True)]
    w = clicks.merged_windows(spark.createDataFrame([(1, -1.0, 3.0), (1, 3.05, 5.0), (1, 5.2, 6.0)], "call_id long, from_s double, to_s double"))
    assert sorted((r["from_s"], r["to_s"]) for r in w.collect()) == [(0.0, 5.0), (5.2, 6.0)]


def call(spark, lines):
    rows = [(1, k, float(10 * k), 10.0 * k + 9, t, None, [(w, 10.0 * k + i * 0.5, 10.0 * k + i * 0.5 + 0.4, 0.9, None) for i, w in enumerate(t.split(" "))]) for k, t in enumerate(lines)]
    return spark.createDataFrame(rows, "call_id long, seg_idx int, start_s double, end_s double, text string, speaker string, words array<struct<word:string,start_s:double,end_s:double,score:double,speaker:string>>")


def test_draft_of_a_support_call(spark):
    s = call(spark, ["Guten Tag.", "Ich kann nicht mehr drucken, es kommt die Meldung: Kein Drucker zugewiesen.", "Das liegt daran, dass der Treiber fehlt.", "Klicken Sie bitte auf „Einstellungen“.", "Dann sehen Sie eine Liste.", "Drücken Sie jetzt auf „Drucker“.", "Es funktioniert jetzt wieder.", "Vielen Dank."])
    refs = S.instructions(s)
    a, st = A.draft(S.sentences(S.words_of(s)), refs, spark.createDataFrame([(1, "de")], "call_id long, language string"))
    a, st = a.first(), st.orderBy("number").collect()
    assert a["problem"].startswith("Ich kann nicht mehr drucken") and a["error_messages"] == ["Kein Drucker zugewiesen"]
    assert a["verification"] == "Es funktioniert jetzt wieder." and a["resolved"] is True and a["keywords"] == ["Einstellungen", "Drucker"]
    assert [x["title"] for x in st] == ["„Einstellungen“ anklicken", "„Drucker“ anklicken"] and st[0]["details"] == "Dann sehen Sie eine Liste."


def test_page_of_an_article(spark):
    a = spark.createDataFrame([(1, "de", "Rechnung lässt sich nicht drucken", "P", ["E`x"], None, None, "V", True, ["k"], ["n"], "rule-based", False)], "call_id long, language string, title string, problem string, error_messages array<string>, cause string, applies_to string, verification string, resolved boolean, keywords array<string>, notes array<string>, method string, private boolean")
    s = spark.createDataFrame([(1, 1, "A", None, "Drücken Sie Strg + P", None, "support", 65.0), (1, 2, "B", "T", "I", "D", "customer", 70.0)], "call_id long, number int, section string, title string, instruction string, details string, actor string, time_s double")
    r = A.markdown(a, s, "2024-01-01").first()
    assert r["slug"] == "rechnung-laesst-sich-nicht-drucken"
    for part in ("---\ntitle: \"Rechnung", "tags: [\"k\"]", "resolved: true", "**Fehlermeldung:** `E'x`", "### A\n\n#### 1. Drücken Sie Strg + P *(nur durch den Support)*", "`Strg` + `P`", "<!-- video 01:05 -->", "### B\n\n#### 2. T", "- n\n"):
        assert part in r["markdown"], part


def test_place_screenshots():
    assert A.place([(0.0, 5.0, 1.0, [(2.0, 0.9, 7), (3.0, 0.5, 8)]), (5.0, 6.0, None, []), (6.0, 6.5, 6.1, [])]) == [(1.9, 7), (5.5, None), (None, None)]


def test_answers_are_read_or_refused(spark):
    sents = spark.createDataFrame([(c, n, float(n), n + 0.5, "t") for c in range(5) for n in (1, 2, 3)], "call_id long, sent_no int, start_s double, end_s double, text string")
    raw = [(0, 'Sure {"title": "T", "cause": "none", "steps": [{"instruction": "B", "sentences": ["[3]"]}, {"instruction": "C", "sentences": []}, {"instruction": "A", "sentences": [1, "2"], "actor": "Support"}], "resolved": true} done'), (1, "no"), (2, '{"steps": [], "resolved": true}'), (3, '{"steps": [], "resolved": false}'), (4, '{"steps": [{"instruction": "x", "sentences": [9]}]}')]
    a, s = A.parsed_answers(spark.createDataFrame(raw, "call_id long, raw string"), sents)
    assert sorted(r["call_id"] for r in a.collect()) == [0, 3]
    assert [(r["instruction"], r["time_s"], r["actor"]) for r in s.where("call_id = 0").orderBy("number").collect()] == [("A", 1.0, "support"), ("B", 3.0, "customer"), ("C", 3.5, "customer")]


def test_word_errors(spark):
    p = spark.createDataFrame([(1, ["The", "cat", "sat", "down."], ["the", "cat", "sits", "down"]), (2, [], []), (3, [], ["x"])], "k int, ref array<string>, hyp array<string>")
    assert [r["wer"] for r in E.word_error_rate(p).orderBy("k").collect()] == [0.25, 0.0, 1.0]
    assert E.follow([("a", 0.0), ("q", 1.0), ("b", 2.0)], [("a", 0.1), ("b", 2.5)]) == [0.1, 0.5]


def frame(dot=None, lit=False):
    a = np.full((180, 320), 40, np.uint8)
    if lit:
        a[80:120, 160:240] = 200
    if dot:
        a[dot[1] : dot[1] + 4, dot[0] : dot[0] + 4] = 230
    return a


def test_frames_show_a_change_and_the_cursor(spark):
    shots = [frame((20 + 10 * min(k, 18), 100), k >= 30) for k in range(40)]
    d = spark.createDataFrame(pd.DataFrame({"call_id": 1, "frame_idx": range(40), "pts_s": [k / 20 for k in range(40)], "width": 320, "height": 180, "pixels": [s.tobytes() for s in shots]}))
    d = d.selectExpr("call_id", "cast(frame_idx as int) frame_idx", "pts_s", "cast(width as int) width", "cast(height as int) height", "pixels")
    s = P.frame_scores(d)
    best = s.orderBy(F.col("fraction").desc()).first()
    assert best["time_s"] == 1.5 and (best["x1"], best["y1"], best["x2"], best["y2"]) == (160, 80, 240, 120)
    last = P.cursor_track(d).where("time_s < 1.5").orderBy(F.col("time_s").desc()).first()
    assert (last["x"], last["y"]) == (200, 100)
    t = P.thumbnails(d, 160).collect()
    assert [(x["frame_idx"], x["width"], x["height"]) for x in t] == [(0, 160, 90), (20, 160, 90)]


def test_services_fall_back(spark):
    def fails(rows):
        raise RuntimeError("down")

    M.register("tracker", "p", fails)
    M.register("tracker", "f", lambda rows: pd.Series(["ok"]))
    got = M.answered(spark.range(3), "tracker", "p", "f", sticky=True).collect()
    assert {(g["answer"], g["status"], g["model"]) for g in got} == {("ok", "fallback", "f")}
    assert M.answered(spark.range(1), "tracker", "p").first()["status"] == "failed"


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, float(t), r.choice([0.0, 0.01, 0.02, 0.5])) for c in range(4) for t in range(40)]
    spark.createDataFrame(rows, "call_id long, time_s double, fraction double").repartition(1).write.parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "s"))
    got = {(x["call_id"], x["time_s"]) for x in Z.run_to_end(Z.state_changes(stream)).collect()}
    assert got == {(x["call_id"], x["time_s"]) for x in clicks.state_changes(batch, ["time_s"]).collect() if x["time_s"] < 39}


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    schema = "call_id long, ref_seq long, anchor_ts timestamp"
    for k, part in enumerate([[(1, 0, at(100))], [(1, 1, at(200))], [(1, 2, at(50)), (1, 3, at(201))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "r" / str(k)))
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    n = files.withWatermark("anchor_ts", "10 seconds").groupBy(F.window("anchor_ts", "1 second")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("s"), "n")
    assert {str(r["s"])[-5:] for r in Z.run_to_end(n).collect()} <= {"01:40", "00:50"}


def test_descriptions(spark):
    e = spark.createDataFrame([(1, "event_0000", "click", "observed", 0.83, [("cursor_tracker", 0.9), ("frame_state_change", 0.8)])], "call_id long, event_id string, type string, grounding_status string, overall_confidence double, evidence array<struct<source:string,confidence:double>>")
    e = e.withColumns({"spatial": F.struct(F.array(F.lit(1489), F.lit(836)).alias("point_xy_px")), "target": F.struct(F.lit("ui_000").alias("object_id"), F.lit("button").alias("class"), F.lit("Save").alias("text"), F.array(*map(F.lit, (1400, 800, 1500, 850))).alias("bbox_xyxy_px")), "audio_references": F.array(F.lit(1))})
    assert e.select(D.description("en")).first()[0] == 'The visible mouse cursor clicks at x=1489, y=836 on the button "Save" in the lower right area of the window. The element occupies approximately [1400, 800]–[1500, 850] px. The view changes immediately afterwards. The association with the spoken instruction is rated at 0.83 overall confidence.'
