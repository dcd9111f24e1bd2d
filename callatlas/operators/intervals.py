"""Joins of intervals in time: both sides are cut into buckets, so that a long call is many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A span that reaches over so many buckets or more goes into buckets that are as many times as wide.
LONG = 64


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], wide: float = 8.0) -> DataFrame:
    """Rows of one call_id whose spans (expressions of low and high, ends included) meet. Besides call_id the sides share no
    column names. A span without a low end meets nothing.

    Each side has a row for each bucket of wide seconds that it touches, and a pair is told in the first bucket of both, so
    once. Long spans go into wide buckets instead, where all of the other side has a row or two more; two points in
    time need none of this, so a side pays only if the other has spans. A key is twice the bucket, and one more if it is wide.
    """
    (a, b), (c, d) = left_span, right_span
    at = lambda t, w: f"cast(floor(({t}) / {wide * (LONG if w else 1)}D) as bigint)"
    high = lambda p, q: p if p == q else f"greatest({p}, {q})"
    is_long = lambda p, q: "false" if p == q else f"({at(high(p, q), 0)} - {at(p, 0)} >= {LONG})"
    keys = lambda p, q, w: f"transform(sequence({at(p, w)}, {at(high(p, q), w)}), k -> k * 2 + {w})"

    def cut(p: str, q: str, other: tuple[str, str]):
        short = keys(p, q, 0) if other[0] == other[1] else f"concat({keys(p, q, 0)}, {keys(p, q, 1)})"
        return F.explode(F.expr(short if p == q else f"if({is_long(p, q)}, {keys(p, q, 1)}, {short})"))

    r = right.withColumn("right_bucket", cut(c, d, left_span)).withColumnRenamed("call_id", "right_call")
    met = F.expr(f"call_id = right_call and left_bucket = right_bucket and ({a}) <= ({d}) and ({c}) <= ({b})")
    first = F.expr(f"left_bucket = if({is_long(a, b)} or {is_long(c, d)}, greatest({at(a, 1)}, {at(c, 1)}) * 2 + 1, greatest({at(a, 0)}, {at(c, 0)}) * 2)")
    return left.withColumn("left_bucket", cut(a, b, right_span)).join(r, met & first).drop("left_bucket", "right_bucket", "right_call")
