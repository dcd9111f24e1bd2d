"""Key frames and settled screenshots against plain loops over whole calls."""

import random

import numpy as np
import pytest

from callatlas.operators import frames as P


def loop_key_frames(shots, clicks, most=12):
    found = [(50.0, 0)] if shots else []
    for i in range(1, len(shots)):
        change = P.difference(shots[i][2], shots[i - 1][2])
        moving = P.difference(shots[i][2], shots[i + 1][2]) if i + 1 < len(shots) else 0.0
        click = any(abs(c - shots[i][1]) <= 0.75 for c in clicks)
        if click or (change >= 2.5 and moving < 5):
            found.append((change + (100 if click else 0), i))
    taken = []
    for _, i in sorted(found, key=lambda x: -x[0]):
        if len(taken) < most and all(P.difference(shots[k][2], shots[i][2]) >= 2.5 and abs(shots[k][1] - shots[i][1]) >= 2 for k in taken):
            taken.append(i)
    return {shots[i][0] for i in taken}


def loop_screenshots(steps, shots):
    out, prev = {}, None
    for number, start, end, shot, click in steps:
        stop = shot + 0.5 if click else min(max(end, start + 1) + 1, start + 15)
        own = [s for s in shots if (shot if click else start) <= s[1] <= stop]
        out[number] = shot
        if click:
            prev = own[0][2] if own else prev
            continue
        rated = []
        for i, (_, t, a) in enumerate(own):
            moving = P.difference(a, own[i + 1][2]) if i + 1 < len(own) else 0.0
            new = 255.0 if prev is None else P.difference(a, prev)
            rated.append((min(new, 40) - 2 * moving - (0.05 * abs(t - shot) if shot is not None else 0), -i, t, a, new))
        if rated:
            _, _, t, a, new = max(rated, key=lambda x: x[:2])
            if prev is not None and new < 2.5:
                out[number] = None
            else:
                out[number], prev = t, a
    return out


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(5)
    shots = {}
    for call in (1, 2, 3):
        level, rows = 0, []
        for k in range(1 if call == 3 else 90):
            level = r.choice([level, level, level, level + 1, level + 20, 200]) % 250
            a = np.full((6, 8), 10, np.uint8)
            a[: 3 + k % 2, :4] = level
            rows.append((k * 4, k + r.choice([0.0, 0.25, 0.5]), a))
        shots[call] = rows
    flat = [(c, i, t, a.shape[1], a.shape[0], a.tobytes(), "more") for c, rows in shots.items() for i, t, a in rows]
    r.shuffle(flat)
    return shots, spark.createDataFrame(flat, "call_id long, frame_idx int, pts_s double, width int, height int, pixels binary, extra string").repartition(5)


def test_key_frames_are_those_of_a_loop(spark, calls):
    shots, table = calls
    clicks = {1: [3.25, 3.5, 40.0, 77.75, 500.0], 2: [], 4: [1.0]}
    c = spark.createDataFrame([(k, t) for k, ts in clicks.items() for t in ts], "call_id long, time_s double")
    for most in (3, 12):
        got = {(x["call_id"], x["frame_idx"]) for x in P.key_frames(table, c, most).collect()}
        assert got == {(k, i) for k, rows in shots.items() for i in loop_key_frames(rows, clicks.get(k, []), most)}
    assert P.key_frames(table, c.limit(0)).count() == sum(len(loop_key_frames(rows, [])) for rows in shots.values())
    assert P.key_frames(table.limit(0), c).count() == 0


def test_screenshots_are_those_of_a_loop(spark, calls):
    shots, table = calls
    r = random.Random(8)
    steps = {}
    for call in (1, 2, 3, 9):  # 9 has no thumbnails; numbers need not follow time
        starts = [r.randrange(0, 100) / 1.0 for _ in range(25)]
        steps[call] = [(n + 1, t, t + r.choice([0.0, 0.5, 4.0, 30.0]), r.choice([t + 0.5, t + 2]) if n % 3 == 0 else r.choice([None, t + 1]), n % 3 == 0) for n, t in enumerate(starts)]
    s = spark.createDataFrame([(c, *x) for c, rows in steps.items() for x in rows], "call_id long, number int, time_s double, end_s double, screenshot_s double, has_click boolean").repartition(3)
    got = {(x["call_id"], x["number"]): x["screenshot_s"] for x in P.settled_screenshots(s, table).collect()}
    want = {(c, n): t for c, rows in steps.items() for n, t in loop_screenshots(rows, shots.get(c, [])).items()}
    assert got == want and sum(v is None for v in got.values()) > 10
    assert P.settled_screenshots(s.limit(0), table).count() == 0


def test_no_call_is_a_group(spark, calls):
    s = spark.createDataFrame([], "call_id long, number int, time_s double, end_s double, screenshot_s double, has_click boolean")
    for df in (P.key_frames(calls[1], s.select("call_id", "time_s")), P.settled_screenshots(s, calls[1])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan


def test_thumbnails_are_never_broadcast(spark, calls):
    s = spark.createDataFrame([(1, 1, 0.0, 5.0, 1.0, False)], "call_id long, number int, time_s double, end_s double, screenshot_s double, has_click boolean")
    df = P.settled_screenshots(s, calls[1])  # few rows by Spark's estimate
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
