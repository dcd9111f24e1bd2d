"""Gluing against a loop, services by whole batches, counters by panes."""

import datetime
import random

import pandas as pd
import pytest

from callatlas.operators import model_steps as M
from callatlas.operators import transcripts as S
from callatlas.streaming import streams as Z


def loop(rows, most=40):
    out = []
    for start, end, text, speaker in rows:
        if len(text) < 3:
            continue
        if out:
            last = out[-1]
            new, old = len(text.split(" ")), len(last[2].split(" "))
            if last[3] == speaker and last[2][-1] not in ".!?…" and start - last[1] < 1.0 and (new <= 6 or old <= 6) and new + old <= most + 5:
                last[1], last[2] = end, f"{last[2]} {text[0].lower()}{text[1:]}"
                continue
        out.append([start, end, text, speaker])
    return [tuple(x) for x in out]


def test_sentences_are_glued_as_by_a_loop(spark):
    r = random.Random(3)
    calls = {}
    for call in range(12):
        rows, t = [], 0.0
        for _ in range(r.choice([1, 5, 200])):
            t += r.choice([0.0, 0.25, 0.5, 1.0, 3.0]) if call % 3 else 0.0
            text = " ".join(["Wört"] * r.choice([1, 1, 2, 3, 6, 7, 20, 39, 40])) if call != 5 else r.choice(["ab", "Äh", "…", "Nun"])
            rows.append((t, t + 0.5, text + (r.choice(["", "", "", ".", "…"]) if call % 2 else ""), r.choice(["A", "A", None] if call % 4 == 0 else ["A"])))
            t += 0.5
        calls[call] = rows
    flat = [(c, k // 3, k % 3, *x) for c, rows in calls.items() for k, x in enumerate(rows)]
    r.shuffle(flat)
    p = spark.createDataFrame(flat, "call_id long, seg_idx int, piece int, start_s double, end_s double, text string, speaker string").repartition(5)
    got = {}
    for x in S.glued(p).orderBy("call_id", "sent_no").collect():
        got.setdefault(x["call_id"], []).append((x["start_s"], x["end_s"], x["text"], x["speaker"]))
        assert x["sent_no"] == len(got[x["call_id"]])
    assert got == {c: loop(rows) for c, rows in calls.items() if loop(rows)}
    assert any(len(s[2].split(" ")) > 40 for rows in got.values() for s in rows)
    assert S.glued(p.limit(0)).count() == 0


def test_bad_rows_are_found_by_halves():
    n, bad, calls = 256, {3, 77, 200}, []

    def service(rows):
        calls.append(len(rows))
        if set(rows.k) & bad:
            raise RuntimeError("bad")
        return rows.k * 2

    rows = pd.DataFrame({"k": range(n)})
    assert M.asked(service, rows) == [(None, "bad") if k in bad else (2 * k, None) for k in range(n)]
    assert len(calls) <= 1 + 2 * len(bad) * 8
    calls.clear()
    assert M.asked(service, rows.iloc[:3]) == [(0, None), (2, None), (4, None)] and calls == [3]
    assert M.asked(service, rows, sticky=True) == [(0, None), (2, None), (4, None), (None, "bad")] + [None] * (n - 4)
    assert M.asked(service, rows.iloc[:0]) == []
    assert M.asked(lambda rows: [1], rows.iloc[:2]) == [(1, None), (1, None)]  # one answer for two requests is a failure


@pytest.mark.parametrize("sticky", [False, True])
def test_answers_of_batches(spark, sticky):
    def picky(rows):
        if (rows.id % 5 == 4).any():
            raise RuntimeError("busy")
        return "p" + rows.id.astype(str)

    def spare(rows):
        if (rows.id == 9).any():
            raise RuntimeError("down")
        return "f" + rows.id.astype(str)

    M.register("tracker", "picky", picky)
    M.register("tracker", "spare", spare)
    got = {x["id"]: tuple(x)[1:] for x in M.answered(spark.range(0, 20, 1, 1), "tracker", "picky", "spare", sticky, most=8).collect()}
    note = "picky not usable (busy)"
    for k in range(20):
        own = k % 5 != 4 and not (sticky and k > 4)
        told = note if k % 5 == 4 and (k == 4 or not sticky) else None
        failed = (None, "failed", f"{note}; down" if told else "down", "spare")
        assert got[k] == ((f"p{k}", "ok", None, "picky") if own else failed if k == 9 else (f"f{k}", "fallback", told, "spare")), k
    alone = {x["id"]: (x["answer"], x["status"], x["note"]) for x in M.answered(spark.range(0, 20, 1, 1), "tracker", "picky", sticky=sticky).collect()}
    assert alone == {k: (None, "failed", note) if k % 5 == 4 else (f"p{k}", "ok", None) for k in range(20)}


def test_counters_add_up_panes(spark, tmp_path):
    r = random.Random(4)
    start = datetime.datetime(2024, 5, 1)
    rows = [(r.randrange(5000), start + datetime.timedelta(seconds=r.randrange(6 * 3600)), r.choice(["a", "b", None])) for _ in range(30000)]
    spark.createDataFrame(rows, "call_id long, ts timestamp, kind string").repartition(3).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("call_id long, ts timestamp, kind string").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "e"))
    got = {(x["from_ts"], x["kind"]): (x["n"], x["calls"]) for x in Z.run_to_end(Z.counters(events)).collect()}
    closed = max(t for _, t, _ in rows) - datetime.timedelta(hours=1)
    want = {}
    for call, t, kind in rows:
        first = t.replace(minute=t.minute // 15 * 15, second=0)
        for k in range(4):
            hour = first - k * datetime.timedelta(minutes=15)
            if hour + datetime.timedelta(hours=1) <= closed:
                want.setdefault((hour, kind), []).append(call)
    assert set(got) == set(want)
    for key, calls in want.items():
        assert got[key][0] == len(calls) and abs(got[key][1] - len(set(calls))) <= 0.03 * len(set(calls))
