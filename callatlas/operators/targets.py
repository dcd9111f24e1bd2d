"""Targets on screen: points and spoken texts to elements, pointing answers, tracker samples, element registry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity
from .intervals import overlapping
from .keys import keyed


def _first_element(events: DataFrame, elements: DataFrame, shift: float, tolerance: float, name: str) -> DataFrame:
    """The element at each event's point, of those visible around time + shift: interactive first, then the smallest."""
    e = elements.select("call_id", F.col("element_seq").alias(name), "x1", "y1", "x2", "y2", "interactive_confidence", "first_seen_s", "last_seen_s")
    at = f"time_s + {shift}D"
    pairs = overlapping(events.where("x is not null").select("call_id", "vis_seq", "time_s", "x", "y"), e, (at, at), (f"first_seen_s - {tolerance}D", f"last_seen_s + {tolerance}D"))
    pairs = pairs.where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
    area = (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))
    return pairs.groupBy("call_id", "vis_seq").agg(F.min_by(name, F.struct(F.when(F.col("interactive_confidence") >= 0.5, 0).otherwise(1), area, name)).alias(name))


def targets_at_points(events: DataFrame, elements: DataFrame) -> DataFrame:
    """C4: events with target_seq: what was visible just before the event, else around it."""
    early = _first_element(events, elements, -0.3, 0.6, "early_seq")
    late = _first_element(events, elements, 0.0, 1.0, "late_seq")
    return events.join(early, ["call_id", "vis_seq"], "left").join(late, ["call_id", "vis_seq"], "left").withColumn("target_seq", F.coalesce("early_seq", "late_seq")).drop("early_seq", "late_seq")


def spoken_targets(refs: DataFrame, elements: DataFrame, least: float = 0.6, tolerance: float = 2.0) -> DataFrame:
    """For each spoken target the visible element with the most similar text; ties to the earlier element."""
    r = refs.where("explicit_target is not null").select("call_id", "ref_seq", "anchor_s", "explicit_target")
    e = elements.where("text is not null").select("call_id", "element_seq", F.col("text").alias("seen_text"), "first_seen_s", "last_seen_s")
    p = overlapping(r, e, ("anchor_s", "anchor_s"), (f"first_seen_s - {tolerance}D", f"last_seen_s + {tolerance}D"))
    # texts that differ in length by more than the similarity allows need no edit distance
    a, b = F.length(F.trim("explicit_target")), F.length(F.trim("seen_text"))
    p = p.where(F.least(a, b) >= least * F.greatest(a, b)).withColumn("sim", similarity(F.col("seen_text"), F.col("explicit_target"))).where(F.col("sim") >= least)
    return p.groupBy("call_id", "ref_seq", "anchor_s").agg(F.max_by(F.struct("element_seq", "sim"), F.struct("sim", -F.col("element_seq"))).alias("b")).select("call_id", "ref_seq", "anchor_s", "b.*")


def assign_spoken_targets(events: DataFrame, found: DataFrame, within: float = 2.5) -> DataFrame:
    """Events still without a target take that of the earliest reference within the tolerance, and its evidence."""
    near = found.select("call_id", "ref_seq", "anchor_s", F.col("element_seq").alias("spoken_seq"))
    p = overlapping(events.where("target_seq is null").select("call_id", "vis_seq", "time_s"), near, (f"time_s - {within}D", f"time_s + {within}D"), ("anchor_s", "anchor_s")).where(F.abs(F.col("time_s") - F.col("anchor_s")) <= within)
    first = p.groupBy("call_id", "vis_seq").agg(F.min_by("spoken_seq", "ref_seq").alias("spoken_seq"))
    evidence = F.array(F.struct(F.lit("vlm_semantic").alias("source"), F.lit(0.5).alias("confidence")))
    j = events.join(first, ["call_id", "vis_seq"], "left")
    return j.withColumns({"evidence": F.when(F.col("spoken_seq").isNotNull(), F.concat("evidence", evidence)).otherwise(F.col("evidence")), "target_seq": F.coalesce("target_seq", "spoken_seq")}).drop("spoken_seq")


def pointing_fallback(events: DataFrame, points: DataFrame) -> DataFrame:
    """C20: events without a point take the most confident pointing answer, as source vlm_pointing, with its evidence."""
    best = points.groupBy("call_id", "vis_seq").agg(F.max_by(F.struct(F.col("x").alias("px"), F.col("y").alias("py"), F.col("confidence").alias("pc")), F.struct("confidence", -F.col("time_s"))).alias("p"))
    j = events.join(best, ["call_id", "vis_seq"], "left")
    use = F.col("x").isNull() & F.col("p").isNotNull()
    extra = F.array(F.struct(F.lit("vlm_pointing").alias("source"), F.col("p.pc").alias("confidence")))
    return j.withColumn("use", use).withColumns({"x": F.when(F.col("use"), F.col("p.px")).otherwise(F.col("x")), "y": F.when(F.col("use"), F.col("p.py")).otherwise(F.col("y")), "point_source": F.when(F.col("use"), "vlm_pointing").otherwise(F.col("point_source")), "evidence": F.when(F.col("use"), F.concat("evidence", extra)).otherwise(F.col("evidence"))}).drop("p", "use")


def tracker_evidence(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The mean confidence of an event's tracker samples as sam2 evidence."""
    mean = samples.groupBy("call_id", "vis_seq").agg(F.avg("confidence").alias("tracked"))
    extra = F.array(F.struct(F.lit("sam2").alias("source"), F.col("tracked").alias("confidence")))
    return events.join(mean, ["call_id", "vis_seq"], "left").withColumn("evidence", F.when(F.col("tracked").isNotNull(), F.concat("evidence", extra)).otherwise(F.col("evidence"))).drop("tracked")


def seen_longer(elements: DataFrame, events: DataFrame, samples: DataFrame) -> DataFrame:
    """Elements with first and last seen widened by the tracker samples of events that target them."""
    span = samples.join(events.where("target_seq is not null").select("call_id", "vis_seq", F.col("target_seq").alias("element_seq")), ["call_id", "vis_seq"]).groupBy("call_id", "element_seq").agg(F.min("time_s").alias("low"), F.max("time_s").alias("high"))
    return elements.join(span, ["call_id", "element_seq"], "left").withColumns({"first_seen_s": F.least("first_seen_s", "low"), "last_seen_s": F.greatest("last_seen_s", "high")}).drop("low", "high")


REGISTRY = "call_id long, element_seq int, x1 int, y1 int, x2 int, y2 int, text string, text_confidence double, interactive_confidence double, class string, first_seen_s double, last_seen_s double, observations int"


def text_likeness(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    a, b = a.strip().lower(), b.strip().lower()
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b))


def _overlap(p: list, q: list) -> float:
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    inter = max(w, 0) * max(h, 0)
    union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter
    return inter / union if union > 0 else 0.0


def observe(elements: list[dict], time_s: float, d: dict, least_iou: float = 0.5, least_text: float = 0.7) -> int:
    """One detection into a call's elements: joins the best match and moves it, or becomes a new one; the element's place."""
    best, most, place = None, 0.0, len(elements)
    for k, e in enumerate(elements):
        overlap = _overlap(e["box"], d["box"])
        if overlap < least_iou:
            continue
        like = text_likeness(e["text"], d["text"])
        if e["text"] is not None and d["text"] is not None and like < least_text:
            continue
        if overlap + 0.5 * like > most:
            best, most, place = e, overlap + 0.5 * like, k
    if best is None:
        elements.append({**d, "first": time_s, "last": time_s, "n": 1})
        return place
    best["n"] += 1
    best["last"] = max(best["last"], time_s)
    best["box"] = [round(a + 0.3 * (b - a)) for a, b in zip(best["box"], d["box"], strict=True)]
    if d["text"] is not None and d["text_confidence"] >= best["text_confidence"]:
        best["text"], best["text_confidence"] = d["text"], d["text_confidence"]
    best["interactive_confidence"] = max(best["interactive_confidence"], d["interactive_confidence"])
    if best["class"] == "unknown":
        best["class"] = d["class"]
    return place


def detection(r) -> dict:
    text = None if pd.isna(r.text) else r.text
    return {"box": [int(r.x1), int(r.y1), int(r.x2), int(r.y2)], "text": text, "text_confidence": float(r.text_confidence), "interactive_confidence": float(r.interactive_confidence), "class": getattr(r, "class_", "unknown") or "unknown"}


def stable_elements(detections: DataFrame) -> DataFrame:
    """H6: elements of each call from its detections (call_id, time_s, det_seq, box, text, confidences, class) in time order."""

    names = [c.split()[0] for c in REGISTRY.split(", ")]

    def run(batches):
        now, held = None, []
        told = lambda: pd.DataFrame([[now, k, *e["box"], e["text"], e["text_confidence"], e["interactive_confidence"], e["class"], e["first"], e["last"], e["n"]] for k, e in enumerate(held)], columns=names)
        for b in batches:
            for r in b.rename(columns={"class": "class_"}).itertuples(index=False):
                if r.call_id != now:
                    if held:
                        yield told()
                    now, held = r.call_id, []
                observe(held, float(r.time_s), detection(r))
        yield told()

    d = detections.select("call_id", "time_s", "det_seq", "x1", "y1", "x2", "y2", "text", "text_confidence", "interactive_confidence", "class")
    return d.repartition("call_id").sortWithinPartitions("call_id", F.asc_nulls_last("time_s"), "det_seq").mapInPandas(run, keyed(REGISTRY, detections))


def merged_boxes(text_boxes: DataFrame, interactive: DataFrame, least: float = 0.5) -> DataFrame:
    """Per frame, interactive boxes joined into the text boxes by best overlap, or added; (call_id, time_s, x1..y2, text,
    text_confidence, interactive_confidence)."""
    cols = ["call_id", "time_s", "seq", "x1", "y1", "x2", "y2", "text", "text_confidence", "interactive_confidence", "is_text"]
    both = text_boxes.withColumns({"interactive_confidence": F.lit(0.2), "is_text": F.lit(True)}).select(*cols).union(interactive.withColumns({"text": F.lit(None).cast("string"), "text_confidence": F.lit(0.0), "is_text": F.lit(False)}).select(*cols))
    schema = "call_id long, time_s double, x1 int, y1 int, x2 int, y2 int, text string, text_confidence double, interactive_confidence double"

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        now, held = None, []
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                if (r.call_id, r.time_s) != now:
                    done, held, now = done + held, [], (r.call_id, r.time_s)
                box = [r.x1, r.y1, r.x2, r.y2]
                best = max(held, key=lambda e: _overlap(e[2:6], box), default=None) if not r.is_text else None
                if best is not None and _overlap(best[2:6], box) >= least:
                    best[8] = max(best[8], r.interactive_confidence)
                else:
                    held.append([r.call_id, r.time_s, *box, r.text, r.text_confidence, r.interactive_confidence])
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame(held, columns=names)

    return both.repartition("call_id", "time_s").sortWithinPartitions("call_id", "time_s", F.desc("is_text"), "seq").mapInPandas(run, keyed(schema, text_boxes))


def requests(events: DataFrame, calls: DataFrame) -> DataFrame:
    """H7: what to ask the model steps for: a frame before and one after each event, a pointing clip where no point is known, a
    tracking span where a target is, and a clip of the words with a second on both sides; all within the call."""
    t, end = F.col("time_s"), F.col("duration_s")
    ask = lambda service, low, high: F.struct(F.lit(service).alias("service"), F.greatest(F.lit(0.0), F.least(end, low)).alias("from_s"), F.least(end, high).alias("to_s"))
    asks = F.array(
        ask("ui_frame", t - 0.3, t - 0.3), ask("ui_frame", t + 0.4, t + 0.4),
        F.when(F.col("x").isNull(), ask("pointing", t - 0.5, t + 0.5)),
        F.when(F.col("target_seq").isNotNull(), ask("tracking", t - 1, t + 1)),
        ask("narrative", F.col("start_s") - 1, F.col("end_s") + 1),
    )
    e = events.join(calls.select("call_id", "duration_s"), "call_id").select("call_id", "vis_seq", F.explode(F.array_compact(asks)).alias("a"))
    return e.select("call_id", "vis_seq", "a.service", F.least("a.from_s", "a.to_s").alias("from_s"), "a.to_s")
