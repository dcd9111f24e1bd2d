"""Joins in time against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from callatlas.operators.intervals import LONG, overlapping


def spans(seed, n, name):
    """Points, short spans and spans of hours and days, some reversed, before zero, on the edges of buckets or without an end."""
    r, out = random.Random(seed), []
    for k in range(n):
        low = r.choice([r.uniform(-9000, 9000), 8.0 * r.randrange(-50, 50), 512.0 * r.randrange(-9, 9)])
        size = r.choice([0.0, 0.0, r.uniform(0, 9), 8.0, 8.0 * LONG - 8, 8.0 * LONG, r.uniform(0, 3000), r.uniform(0, 200_000), -r.uniform(0, 700)])
        out.append((k % 3, k, None if k == 5 else low, None if k == 5 else low + size))
    return out, f"call_id long, {name} long, {name}0 double, {name}1 double"


@pytest.mark.parametrize("left_point, right_point", [(False, False), (True, False), (False, True), (True, True)])
def test_pairs_are_those_that_meet_each_once(spark, left_point, right_point):
    (x, xs), (y, ys) = spans(1, 120, "a"), spans(2, 120, "b")
    ends = lambda r, point: (r[2], r[2] if point else r[3])
    want = sorted((p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] is not None and q[2] is not None and ends(p, left_point)[0] <= ends(q, right_point)[1] and ends(q, right_point)[0] <= ends(p, left_point)[1])
    left, right = spark.createDataFrame(x, xs), spark.createDataFrame(y, ys)
    got = overlapping(left, right, ("a0", "a0" if left_point else "a1"), ("b0", "b0" if right_point else "b1"))
    assert sorted(map(tuple, got.select("a", "b").collect())) == want and (want or left_point and right_point)
    assert got.columns == [*left.columns, *right.columns[1:]]


def test_a_span_of_a_day_is_few_rows(spark, monkeypatch):
    x = spark.createDataFrame([(1, 0.0, 86_400.0)], "call_id long, a0 double, a1 double")
    y = spark.range(100).select(F.lit(1).cast("long").alias("call_id"), (F.col("id") * 860.0).alias("b0"))
    rows, join = [], type(x).join
    monkeypatch.setattr(type(x), "join", lambda me, other, *a: rows.append((me.count(), other.count())) or join(me, other, *a))
    assert overlapping(x, y, ("a0", "a1"), ("b0", "b0")).count() == 100
    assert rows == [(86_400 // (8 * LONG) + 1, 200)]
