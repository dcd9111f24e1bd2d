"""Spoken references and visual events: range join, score, one-to-one assignment, grounded events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity
from .keys import keyed

BEFORE, AFTER, TAU, LEAST = 1.5, 2.5, 0.75, 0.35
WEIGHTS = {"time": 0.35, "semantic": 0.20, "pointer": 0.15, "ui": 0.15, "change": 0.15, "bonus": 0.15}
CLICKY = ("click", "double_click", "right_click", "tap", "select")
#: Evidence sources from strong to weak.
RANK = ["telemetry", "cursor_tracker", "finger_homography", "frame_state_change", "sam2", "omniparser", "paddleocr", "vlm_pointing", "vlm_semantic"]


def semantic_match(spoken: Column, seen: Column) -> Column:
    """B10"""
    return F.when(spoken == seen, 1.0).when((spoken == "unknown") | (seen == "unknown"), 0.5).when(spoken.isin(*CLICKY) & seen.isin(*CLICKY), 0.7).when((spoken == "point") & seen.isin(*CLICKY), 0.5).otherwise(0.25)


def grounding_status(has_point: Column, source: Column) -> Column:
    """No point is unobservable whatever the source; sources between tracker and model fall to inferred."""
    return F.when(~has_point, "unobservable").when(source.isin("telemetry", "cursor_tracker", "finger_homography", "frame_state_change"), "observed").when(source == "sam2", "tracked").otherwise("inferred")


def in_window(refs: DataFrame, events: DataFrame, before: float = BEFORE, after: float = AFTER) -> DataFrame:
    """Pairs of one call with anchor - before <= time <= anchor + after.

    Time is cut into buckets as wide as the window, so a reference looks into two at most; the join is by equality on
    call and bucket, and long calls spread over their buckets.
    """
    wide = before + after
    bucket = lambda t: F.floor(t / wide)
    r = refs.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("anchor_s") - before), bucket(F.col("anchor_s") + after)))))
    e = events.withColumn("bucket", bucket(F.col("time_s")))
    return r.join(e, ["call_id", "bucket"]).where((F.col("time_s") >= F.col("anchor_s") - before) & (F.col("time_s") <= F.col("anchor_s") + after)).drop("bucket")


def score(target_text: Column) -> Column:
    """Of a pair with the columns of both sides."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = WEIGHTS
    s = w["time"] * F.exp(-F.abs(F.col("time_s") - F.col("anchor_s")) / TAU) + w["semantic"] * semantic_match(F.col("spoken_action"), F.col("action")) + w["pointer"] * F.when(F.col("x").isNotNull(), 1.0).otherwise(0.2) + w["ui"] * clamp(F.col("ui_interactive_confidence")) + w["change"] * clamp(F.col("state_change_confidence"))
    s = s + F.when(F.coalesce(similarity(F.col("explicit_target"), target_text), F.lit(0.0)) >= 0.6, w["bonus"]).otherwise(0.0)
    return clamp(s) * clamp(F.col("detector_confidence"))


def candidates(refs: DataFrame, events: DataFrame, least: float = LEAST) -> DataFrame:
    """C2 on C1: pairs scoring least or more."""
    pairs = in_window(refs, events)
    target = F.col("target_text") if "target_text" in events.columns else F.lit(None).cast("string")
    return pairs.withColumn("score", score(target)).where(F.col("score") >= least)


def resolve(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of each call, best score first, then reference and event order; references of one start keep their
    spoken order. A call whose pairs fall into sessions apart in time is cut there, so a long call is many small groups."""
    w = W.partitionBy("call_id").orderBy("start_s", "ref_seq", "vis_seq")
    reach = F.max("time_s").over(w.rowsBetween(W.unboundedPreceding, -1))
    lag = F.max(F.col("start_s")).over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.col("start_s") > lag + 30) & (F.least("time_s", "anchor_s") > reach + 30)
    p = pairs.select("call_id", "ref_seq", "vis_seq", "score", "start_s", "ordinal", "time_s", "anchor_s").withColumn("session", F.sum(F.when(apart, 1).otherwise(0)).over(w))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heard, seen, by_start = None, set(), set(), {}
        for b in batches:
            taken = []
            names = ("call_id", "session", "ref_seq", "vis_seq", "start_s", "ordinal", "time_s")
            for k, (call, session, ref, vis, start, ordinal, time) in enumerate(zip(*(b.column(n).to_pylist() for n in names), strict=True)):
                if now != (call, session):
                    now, heard, seen, by_start = (call, session), set(), set(), {}
                if ref in heard or vis in seen:
                    continue
                tick = round(start * 1e6)
                others = [x for t in (tick - 1, tick, tick + 1) for x in by_start.get(t, ())]
                if any(abs(s - start) <= 1e-6 and o != ordinal and (time <= t if ordinal > o else time >= t) for s, o, t in others):
                    continue
                heard.add(ref)
                seen.add(vis)
                by_start.setdefault(tick, []).append((start, ordinal, time))
                taken.append(k)
            yield b.select(["call_id", "ref_seq", "vis_seq", "score"]).take(pa.array(taken, pa.int64()))

    p = p.select("call_id", "session", F.col("ref_seq").cast("long").alias("ref_seq"), F.col("vis_seq").cast("long").alias("vis_seq"), "score", "start_s", "ordinal", "time_s")
    dealt = p.repartition("call_id", "session").sortWithinPartitions("call_id", "session", F.col("score").desc(), "ref_seq", "vis_seq")
    return dealt.mapInArrow(pick, keyed("call_id long, ref_seq long, vis_seq long, score double", pairs))


def unbound(refs: DataFrame, bound: DataFrame) -> DataFrame:
    """C15"""
    return refs.join(bound.select("call_id", "ref_seq"), ["call_id", "ref_seq"], "left_anti")


def confidences(events: DataFrame) -> DataFrame:
    """temporal_confidence, spatial_confidence from evidence as strong as the tracker, overall with association_score."""
    strong = F.transform(F.filter("evidence", lambda e: e["source"].isin(*RANK[: RANK.index("sam2") + 1])), lambda e: e["confidence"])
    spatial = F.when(F.col("x").isNull(), 0.0).otherwise(F.coalesce(F.array_max(strong), F.lit(0.4)))
    temporal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("detector_confidence") + 0.4 * F.col("state_change_confidence")))
    e = events.withColumns({"spatial_confidence": spatial, "temporal_confidence": temporal})
    plain = 0.5 * F.col("temporal_confidence") + 0.5 * F.col("spatial_confidence")
    bound = 0.4 * F.col("association_score") + 0.3 * F.col("temporal_confidence") + 0.3 * F.col("spatial_confidence")
    return e.withColumn("overall_confidence", F.bround(F.when(F.col("association_score").isNull(), plain).otherwise(bound), 3))


def relation(deictic: Column, is_bound: Column) -> Column:
    return F.when(~is_bound, "no_visual_event_found").when(deictic, "deictic_instruction_for_event").otherwise("explicit_instruction_for_event")


def grounded_events(events: DataFrame, bound: DataFrame, refs: DataFrame, elements: DataFrame | None = None, width: int = 1920, height: int = 1080) -> DataFrame:
    """C14: a document per event of each call, in time order, with its reference, target, evidence, status and confidences.

    events: call_id, vis_seq, action, time_s, start_s, end_s, x, y, point_source, evidence, confidences, target_seq.
    """
    a = bound.join(refs, ["call_id", "ref_seq"]).select("call_id", "vis_seq", F.col("score").alias("association_score"), F.struct(F.format_string("audio_%04d", F.col("ref_seq")).alias("audio_ref_id"), F.col("speaker").alias("speaker_id"), F.bround("start_s", 3).alias("start_s"), F.bround("end_s", 3).alias("end_s"), F.col("text").alias("transcript"), F.bround("asr_confidence", 3).alias("asr_confidence"), relation(F.col("deictic"), F.lit(True)).alias("relation")).alias("ref"))
    e = confidences(events.join(a, ["call_id", "vis_seq"], "left"))
    if elements is not None:
        t = elements.select("call_id", F.col("element_seq").alias("target_seq"), F.struct(F.format_string("ui_%03d", F.col("element_seq")).alias("object_id"), F.col("class"), F.col("text"), F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy_px")).alias("target"))
        e = e.join(t, ["call_id", "target_seq"], "left")
    else:
        e = e.withColumn("target", F.lit(None).cast("struct<object_id:string,class:string,text:string,bbox_xyxy_px:array<int>>"))
    number = F.row_number().over(W.partitionBy("call_id").orderBy("time_s", "vis_seq")) - 1
    point = F.when(F.col("x").isNotNull(), F.array("x", "y"))
    spatial = F.when(F.col("x").isNotNull() | F.col("target").isNotNull(), F.struct(point.alias("point_xy_px"), F.when(F.col("x").isNotNull(), F.array(F.bround(F.col("x") / width, 4), F.bround(F.col("y") / height, 4))).alias("point_normalized"), F.bround("spatial_confidence", 3).alias("confidence")))
    end = F.when(F.col("end_s") <= 0, F.col("time_s")).otherwise(F.col("end_s"))
    return e.select(
        "call_id", "vis_seq", F.format_string("event_%04d", number).alias("event_id"), F.col("action").alias("type"),
        F.struct(F.bround("start_s", 3).alias("start_s"), F.bround("time_s", 3).alias("peak_s"), F.bround(end, 3).alias("end_s"), F.bround("temporal_confidence", 3).alias("confidence")).alias("temporal"),
        spatial.alias("spatial"), "target", F.when(F.col("ref").isNull(), F.array().cast("array<" + _ref_type(e) + ">")).otherwise(F.array("ref")).alias("audio_references"),
        F.transform("evidence", lambda x: F.struct(x["source"].alias("source"), F.bround(x["confidence"], 3).alias("confidence"))).alias("evidence"),
        grounding_status(F.col("x").isNotNull(), F.col("point_source")).alias("grounding_status"), "overall_confidence",
    )


def _ref_type(df: DataFrame) -> str:
    return df.schema["ref"].dataType.simpleString()
