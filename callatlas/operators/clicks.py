"""Frame scores to state changes, changes and cursor samples to click candidates, analysis windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance

THRESHOLD, SCENE_CUT = 0.0015, 0.6
DELAY, DWELL, SPEED = 0.6, 0.12, 60.0


def state_changes(scores: DataFrame, order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Local maxima of fraction at or above the threshold, not below the one before and above the one after."""
    w = W.partitionBy("call_id").orderBy(*order)
    v = F.col("fraction")
    s = scores.withColumns({"before": F.lag("fraction").over(w), "after": F.lead("fraction").over(w)})
    peak = (F.col("before").isNull() | (v >= F.col("before"))) & (F.col("after").isNull() | (v > F.col("after")))
    return s.where((v >= threshold) & peak).drop("before", "after").withColumns({"confidence": F.greatest(F.lit(0.3), F.least(F.lit(0.98), v / (threshold * 20))), "scene_cut": v >= SCENE_CUT})


def numbered(df: DataFrame, prefix: str, order: list[str], name: str, digits: int = 4) -> DataFrame:
    """Ids like vis_0000 in the order of each call."""
    n = F.row_number().over(W.partitionBy("call_id").orderBy(*order)) - 1
    return df.withColumn(name, F.format_string(f"{prefix}_%0{digits}d", n))


def _near(changes: DataFrame, samples: DataFrame, before: float, after: float) -> DataFrame:
    """Each change with each sample of its call from before seconds earlier to after later; buckets as wide as that."""
    wide = before + after
    c = changes.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("time_s") - before) / wide), F.floor((F.col("time_s") + after) / wide)))))
    s = samples.select("call_id", F.col("time_s").alias("at_s"), "sample_seq", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("confidence").alias("cursor_confidence")).withColumn("bucket", F.floor(F.col("at_s") / wide))
    return c.join(s, ["call_id", "bucket"]).where((F.col("at_s") >= F.col("time_s") - before) & (F.col("at_s") <= F.col("time_s") + after)).drop("bucket")


def cursor_motion(changes: DataFrame, samples: DataFrame, most_px: int = 96, still_px: float = 2.0) -> DataFrame:
    """Changes that are the cursor's own movement: small regions whose nearest sample has moved, or has none before it."""
    # the sample before: strictly earlier in time
    prev = F.expr("max(struct(time_s, sample_seq, x, y)) over (partition by call_id order by time_s range between unbounded preceding and 0.000001D preceding)")
    s = samples.withColumn("prev", prev)
    small = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) <= most_px
    c = changes.where(small)
    wide = 0.22
    c = c.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("time_s") - 0.11) / wide), F.floor((F.col("time_s") + 0.11) / wide)))))
    t = s.select("call_id", F.col("time_s").alias("at_s"), "sample_seq", F.col("x").alias("cx"), F.col("y").alias("cy"), "prev").withColumn("bucket", F.floor(F.col("at_s") / wide))
    near = c.join(t, ["call_id", "bucket"]).where(F.abs(F.col("at_s") - F.col("time_s")) <= 0.11)
    best = near.groupBy("call_id", "change_seq").agg(F.min_by(F.struct("at_s", "cx", "cy", "prev", "x1", "y1", "x2", "y2"), F.struct(F.abs(F.col("at_s") - F.col("time_s")), "at_s", "sample_seq")).alias("b")).select("call_id", "change_seq", "b.*")
    inside = (F.col("cx") >= F.col("x1") - 8) & (F.col("cx") <= F.col("x2") + 8) & (F.col("cy") >= F.col("y1") - 8) & (F.col("cy") <= F.col("y2") + 8)
    moved = distance(F.col("cx"), F.col("cy"), F.col("prev.x"), F.col("prev.y")) > still_px
    return best.where(F.col("prev").isNull() | (moved & inside)).select("call_id", "change_seq")


def click_candidates(changes: DataFrame, samples: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """A candidate for each change that isn't cursor motion.

    The last sample of the window before the change is the click point; dwell reaches back over the samples after the last
    one that was left too fast. Without a sample the point is unobservable. Scene cuts in calls without any cursor go.
    """
    has_cursor = samples.select("call_id").distinct().withColumn("has_cursor", F.lit(True))
    c = changes.join(cursor_motion(changes, samples), ["call_id", "change_seq"], "left_anti").join(has_cursor, "call_id", "left")
    c = c.where(~((F.col("magnitude") >= SCENE_CUT) & F.col("has_cursor").isNull())).drop("has_cursor")
    near = _near(c.select("call_id", "change_seq", "time_s"), samples, DELAY + DWELL, 1e-6)
    w = W.partitionBy("call_id", "change_seq")
    last = F.max(F.struct("at_s", "sample_seq", "cx", "cy", "cursor_confidence")).over(w)
    n = near.withColumn("last", last)
    dt = F.col("last.at_s") - F.col("at_s")
    fast = (dt > 0) & (distance(F.col("cx"), F.col("cy"), F.col("last.cx"), F.col("last.cy")) / dt > SPEED)
    n = n.withColumn("broken", F.max(F.when(fast, F.struct("at_s", "sample_seq"))).over(w))
    kept = F.col("broken").isNull() | (F.struct("at_s", "sample_seq") > F.col("broken"))
    g = n.groupBy("call_id", "change_seq").agg(F.first("last").alias("last"), F.min(F.when(kept, F.col("at_s"))).alias("from_s"))
    j = c.join(g, ["call_id", "change_seq"], "left")
    seen = F.col("last").isNotNull()
    dwell = F.col("last.at_s") - F.col("from_s")
    x, y = F.bround(F.col("last.cx") * scale_x, 0).cast("int"), F.bround(F.col("last.cy") * scale_y, 0).cast("int")
    edge = lambda c, s: (F.col(c) * s).cast("int")
    inside = (x >= edge("x1", scale_x)) & (x <= edge("x2", scale_x)) & (y >= edge("y1", scale_y)) & (y <= edge("y2", scale_y))
    sure = 0.5 * F.col("last.cursor_confidence") + 0.3 * F.when(dwell >= DWELL, 1.0).otherwise(0.4) + 0.2 * F.when(inside, 1.0).otherwise(0.5)
    change = F.struct(F.lit("frame_state_change").alias("source"), F.col("confidence").alias("confidence"))
    cursor = F.struct(F.lit("cursor_tracker").alias("source"), F.col("last.cursor_confidence").alias("confidence"))
    return j.select(
        "call_id", "change_seq", F.lit("click").alias("action"), "time_s",
        F.when(seen, F.greatest(F.lit(0.0), F.col("last.at_s") - dwell)).otherwise(F.col("time_s") - 0.05).alias("start_s"), (F.col("time_s") + 0.1).alias("end_s"),
        F.when(seen, x).alias("x"), F.when(seen, y).alias("y"), F.when(seen, "cursor_tracker").alias("point_source"),
        F.when(seen, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.5 * F.col("confidence")).alias("detector_confidence"),
        F.col("confidence").alias("state_change_confidence"), F.when(seen, F.array(cursor, change)).otherwise(F.array(change)).alias("evidence"),
    )


def fine_over_coarse(coarse: DataFrame, fine: DataFrame, within: float = 0.35) -> DataFrame:
    """Fine candidates, and coarse ones without a fine one within the tolerance, numbered by time."""
    wide = 2 * within
    f = fine.select("call_id", F.col("time_s").alias("fine_s"), F.floor(F.col("time_s") / wide).alias("bucket")).distinct()
    c = coarse.withColumn("bucket_low", F.floor((F.col("time_s") - within) / wide))
    hit = c.select("call_id", "time_s", F.explode(F.array_distinct(F.array("bucket_low", F.floor((F.col("time_s") + within) / wide)))).alias("bucket")).join(f, ["call_id", "bucket"]).where(F.abs(F.col("fine_s") - F.col("time_s")) <= within).select("call_id", "time_s").distinct()
    both = c.drop("bucket_low").join(hit, ["call_id", "time_s"], "left_anti").unionByName(fine)
    return both


def merged_windows(spans: DataFrame, end_s: Column | float | None = None, slack: float = 0.05) -> DataFrame:
    """E5: spans (call_id, from_s, to_s) cut to the call and joined where the gap is at most slack."""
    s = spans.withColumn("from_s", F.greatest("from_s", F.lit(0.0)))
    if end_s is not None:
        s = s.withColumn("to_s", F.least("to_s", end_s if isinstance(end_s, Column) else F.lit(end_s)))
    s = s.where("to_s > from_s")
    w = W.partitionBy("call_id").orderBy("from_s", "to_s")
    reach = F.max("to_s").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("reach", reach)
    s = s.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("from_s") > F.col("reach") + slack), 1).otherwise(0)).over(w))
    return s.groupBy("call_id", "island").agg(F.min("from_s").alias("from_s"), F.max("to_s").alias("to_s")).drop("island")
