"""Exact quantiles, texts that read alike and the nearest of repeated phrases, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callatlas.operators import alike, evaluation
from callatlas.operators.quantiles import exact_quantiles
from callatlas.operators.targets import text_likeness

POINTS = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)


@pytest.mark.parametrize("buckets", [64, 4096])
def test_quantiles_are_those_of_all_values(spark, buckets):
    r = random.Random(1)
    rows = [("a", r.gauss(0, 1) * 10 ** r.randrange(-6, 9)) for _ in range(900)] + [("b", float(r.randrange(4))) for _ in range(300)] + [("c", 7.5), (None, 1.0), (None, 2.0), ("d", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["point"]): r["value"] for r in exact_quantiles(d, "x", POINTS, ("g",), buckets).collect()}
    for g in ("a", "b", "c", None):
        x = [v for k, v in rows if k == g and v is not None and v == v]
        assert [got[g, p] for p in POINTS] == pytest.approx(np.quantile(x, POINTS).tolist(), rel=1e-12)
    assert len(got) == 4 * len(POINTS)
    whole = {r["point"]: r["value"] for r in exact_quantiles(d, "x", POINTS, (), buckets).collect()}
    assert list(whole[p] for p in POINTS) == pytest.approx(np.quantile([v for _, v in rows if v is not None and v == v], POINTS).tolist(), rel=1e-12)
    assert exact_quantiles(d.where("g = 'd'"), "x", POINTS).collect() == []


def test_texts_that_read_alike_are_all_found(spark):
    r = random.Random(5)
    letters = "abcde "
    base = ["".join(r.choice(letters) for _ in range(r.randrange(0, 25))) for _ in range(60)]
    texts = set(base)
    for t in base:
        x = list(t)
        for _ in range(r.randrange(0, 9)):
            if x:
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], [r.choice(letters)], [r.choice(letters), r.choice(letters)]))
        texts.add("".join(x))
    texts = sorted(texts) + [" Padded ", "PADDED", None]
    left, right = [(k % 2, t) for k, t in enumerate(texts)], [((k // 2) % 2, t) for k, t in enumerate(texts)]
    rows = lambda x: spark.createDataFrame(x + x[:5], "call_id int, text string")
    got = sorted(tuple(x) for x in alike.alike_texts(rows(left), rows(right)).collect())
    want = sorted({(c, a, b) for c, a in left for d, b in right if c == d and a is not None and b is not None and text_likeness(a, b) >= 0.6})
    assert got == want and len(want) > 80


def test_a_phrase_said_often_is_looked_up(spark):
    """A phrase of 300 events and 300 true ones: the nearest in time, with no more rows than twice the questions."""
    events = [(1, k, float(2 * k), "click", "observed", k, k, None, -5.0, -4.0, "press the button", f"S{k % 2}") for k in range(300)] + [(1, 900, 4.0, "click", "observed", 0, 0, None, -5.0, -4.0, "press the button", "S9")]
    e = spark.createDataFrame(events, "call_id long, event_seq long, peak_s double, type string, grounding_status string, px int, py int, target_text string, ref_start_s double, ref_end_s double, transcript string, speaker string")
    t = spark.createDataFrame([(1, k, "press the buton", 1000.0, 1001.0, 2 * k + 0.7) for k in range(300)], "call_id long, gt_idx long, action_utterance string, utterance_start_s double, utterance_end_s double, event_time_s double")
    got = {r["gt_idx"]: (r["cand"]["event_seq"], [h["speaker"] for h in r["heard"] if h["event_seq"] == r["cand"]["event_seq"]]) for r in evaluation.matched(t, e).collect()}
    assert got == {k: (k, [f"S{k % 2}"]) for k in range(300)}
    inner = e.select("call_id", "event_seq", "peak_s", "type", "grounding_status", "px", "py", "target_text", "ref_start_s", "ref_end_s", "transcript", F.col("speaker").alias("heard_speaker"))
    assert evaluation._read(t, inner).count() <= 600
