"""Events in words, timelines, event graphs as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stamp

# Wording by language.
VERBS = {
    "de": {"click": "klickt", "double_click": "doppelklickt", "right_click": "klickt mit der rechten Maustaste", "drag": "zieht", "tap": "tippt", "type": "gibt Text ein", "scroll": "scrollt", "select": "wählt aus", "point": "zeigt", None: "wird ausgeführt"},
    "en": {"click": "clicks", "double_click": "double-clicks", "right_click": "right-clicks", "drag": "drags", "tap": "taps", "type": "types", "scroll": "scrolls", "select": "selects", "point": "points", None: "is performed"},
}
CLASSES = {
    "de": {"button": "die Schaltfläche", "icon": "das Symbol", "text": "den Text", "input": "das Eingabefeld", "link": "den Link", "menu": "das Menü", None: "das Element"},
    "en": {"button": "button", "icon": "icon", "text": "text", "input": "input field", "link": "link", "menu": "menu", None: "element"},
}


def worded(c: Column, words: dict) -> Column:
    out = F.lit(words[None])
    for k, v in words.items():
        if k is not None:
            out = F.when(c == k, v).otherwise(out)
    return out


def description(language: str, width: int = 1920, height: int = 1080) -> Column:
    """What an event shows, over the columns of grounded events."""
    de = language == "de"
    has = lambda *s: F.exists("evidence", lambda e: e["source"].isin(*s))
    actor = F.when(has("cursor_tracker", "telemetry"), "Der sichtbare Mauszeiger" if de else "The visible mouse cursor").when(has("finger_homography"), "Der Finger" if de else "The finger").otherwise("Die Aktion" if de else "The action")
    verb = worded(F.col("type"), VERBS[language])
    point, target = F.col("spatial.point_xy_px"), F.col("target")
    box = target["bbox_xyxy_px"]
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    some = lambda cond, *p: F.when(F.coalesce(cond, F.lit(False)), text(*p)).otherwise("")
    number = lambda c, k: c[k].cast("string")
    q = ("„", "“") if de else ('"', '"')
    hidden = text(actor, " ", verb, "; die genaue Position ist im Video nicht beobachtbar" if de else "; the exact position is not observable in the video", some(target["text"].isNotNull(), (" – vermutlich gemeint: " if de else " – probably intended: ") + q[0], target["text"], q[1]), ".")
    x, y = (box[0] + box[2]) / 2.0 / width, (box[1] + box[3]) / 2.0 / height
    third = lambda v, low, mid, high: F.when(v < 0.33, low).when(v > 0.66, high).otherwise(mid)
    across = third(x, "linken", "mittleren", "rechten") if de else third(x, "left", "center", "right")
    down = third(y, "oberen", "mittleren", "unteren") if de else third(y, "upper", "middle", "lower")
    region = text(" im ", across, " ", down, " Bereich des Fensters") if de else text(" in the ", down, " ", across, " area of the window")
    named = text(" auf " if de else " on the ", worded(target["class"], CLASSES[language]), " " + q[0], target["text"], q[1])
    unnamed = text(" auf " if de else " on ", worded(target["class"], CLASSES[language]), " ", target["object_id"])
    at = some(point.isNotNull(), " bei x=" if de else " at x=", number(point, 0), ", y=", number(point, 1))
    on = F.when(target.isNull(), "").otherwise(F.concat(F.when(target["text"].isNotNull(), named).otherwise(unnamed), some(box.isNotNull(), region)))
    hedge = F.when(F.col("grounding_status") == "tracked", " (per Tracking verfolgt)" if de else " (position tracked)").when(F.col("grounding_status") == "inferred", " (Position geschätzt, nicht direkt beobachtet)" if de else " (position inferred, not directly observed)").otherwise("")
    extent = some(box.isNotNull(), " Das Element belegt ungefähr [" if de else " The element occupies approximately [", number(box, 0), ", ", number(box, 1), "]–[", number(box, 2), ", ", number(box, 3), "] px.")
    changed = F.when(F.exists("evidence", lambda e: (e["source"] == "frame_state_change") & (e["confidence"] >= 0.5)), " Unmittelbar anschließend ändert sich die Ansicht." if de else " The view changes immediately afterwards.").otherwise("")
    sure = F.format_string("%.2f", "overall_confidence")
    rated = some(F.size("audio_references") > 0, " Die Zuordnung zur Audioanweisung wird mit " if de else " The association with the spoken instruction is rated at ", F.replace(sure, F.lit("."), F.lit(",")) if de else sure, " Gesamtvertrauen bewertet." if de else " overall confidence.")
    return F.when(F.col("grounding_status") == "unobservable", hidden).otherwise(text(actor, " ", verb, at, on, hedge, ".", extent, changed, rated))


def timeline(events: DataFrame, unbound: DataFrame, language: str) -> DataFrame:
    """G1, F2: (call_id, time_s, place, line) of what is seen and said, in time order by (time_s, place); place keeps the order of
    equal times: per event its speech and then itself, unbound speech last. unbound: call_id, ref_seq, start_s, end_s, speaker, text."""
    de = language == "de"

    def spoken(start: Column, end: Column, speaker: Column, said: Column) -> Column:
        who = F.coalesce(speaker, F.lit("Sprecher" if de else "Speaker"))
        return F.concat(stamp(start), F.lit("–"), stamp(end), F.lit(": "), who, F.lit(" sagt: „" if de else ' says: "'), said, F.lit("“" if de else '"'))

    e = events.withColumn("line", F.concat(stamp(F.col("temporal.peak_s")), F.lit(": "), description(language)))
    place = lambda group, seq, k: F.format_string("%d-%012d-%d", F.lit(group), seq, F.lit(k))
    seen = e.select("call_id", F.col("temporal.peak_s").alias("time_s"), place(0, F.col("vis_seq"), 1).alias("place"), "line")
    r = events.select("call_id", "vis_seq", F.explode("audio_references").alias("r"))
    heard = r.select("call_id", F.col("r.start_s").alias("time_s"), place(0, F.col("vis_seq"), 0).alias("place"), spoken(F.col("r.start_s"), F.col("r.end_s"), F.col("r.speaker_id"), F.col("r.transcript")).alias("line"))
    lost = " (Kein zugeordnetes visuelles Ereignis beobachtet.)" if de else " (No associated visual event observed.)"
    alone = unbound.select("call_id", F.bround("start_s", 3).alias("time_s"), place(1, F.col("ref_seq"), 0).alias("place"), F.concat(spoken(F.bround("start_s", 3), F.bround("end_s", 3), F.col("speaker"), F.col("text")), F.lit(lost)).alias("line"))
    return seen.unionByName(heard).unionByName(alone)


def timeline_text(lines: DataFrame) -> DataFrame:
    """One text per call."""
    return lines.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("time_s", "place", "line"))), lambda x: x["line"]), "\n").alias("timeline"))


def graph_documents(events: DataFrame, unbound: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(call_id, document): the event graph of each call as JSON without nulls; a call without events or references has empty lists."""
    e = events.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "type", "temporal", "spatial", "target", "audio_references", "evidence", "grounding_status", "overall_confidence"))).alias("events"))
    u = unbound.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct(F.format_string("audio_%04d", "ref_seq").alias("audio_ref_id"), F.col("speaker").alias("speaker_id"), F.bround("start_s", 3).alias("start_s"), F.bround("end_s", 3).alias("end_s"), F.col("text").alias("transcript"), F.lit("no_visual_event_found").alias("relation")))).alias("unbound_audio_references"))
    j = e.join(u, "call_id", "full")
    j = j.withColumns({c: F.coalesce(c, F.array().cast(j.schema[c].dataType)) for c in ("events", "unbound_audio_references")})
    video = F.struct(F.col("call_id").cast("string").alias("id"), F.lit(width).alias("width_px"), F.lit(height).alias("height_px"))
    return j.select("call_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), video.alias("video"), "events", "unbound_audio_references"), {"ignoreNullFields": "true"}).alias("document"))
