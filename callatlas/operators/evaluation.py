"""Predictions against ground truth: matching, the combined score, word errors, interval recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance, interval_iou
from ..functions.text import U, similarity
from .alike import alike_texts
from .intervals import overlapping
from .keys import keyed
from .quantiles import exact_quantiles


def nan_if_none(c: Column) -> Column:
    return F.coalesce(c, F.lit(float("nan")))


def matched(truth: DataFrame, events: DataFrame) -> DataFrame:
    """Truth with the predicted event that is nearest in time, of those with a bound utterance that overlaps the true one
    or reads like it. events: one row per event and bound reference, in event order event_seq."""
    e = events.select("call_id", "event_seq", "peak_s", "type", "grounding_status", "px", "py", "target_text", "ref_start_s", "ref_end_s", "transcript", F.col("speaker").alias("heard_speaker"))
    said = overlapping(truth, e, ("utterance_start_s", "utterance_end_s"), ("ref_start_s", "ref_end_s"))
    said = said.where(interval_iou(F.col("ref_start_s"), F.col("ref_end_s"), F.col("utterance_start_s"), F.col("utterance_end_s")) > 0)
    p = said.unionByName(_read(truth, e))
    best = p.groupBy("call_id", "gt_idx").agg(F.min_by(F.struct("event_seq", "peak_s", "type", "grounding_status", "px", "py", "target_text"), F.struct(F.abs(F.col("peak_s") - F.col("event_time_s")), "event_seq")).alias("cand"), F.collect_set(F.struct("event_seq", F.col("heard_speaker").alias("speaker"))).alias("heard"))
    return truth.join(best, ["call_id", "gt_idx"], "left")


def _read(truth: DataFrame, e: DataFrame) -> DataFrame:
    """truth with the events that read like it: of each text that does, the nearest in time on both sides, so that a phrase said
    many times is looked up, not paired."""
    alike = alike_texts(truth.select("call_id", F.col("action_utterance").alias("text")), e.select("call_id", F.col("transcript").alias("text")))
    asked = truth.join(alike.withColumnsRenamed({"a": "action_utterance", "b": "transcript"}), ["call_id", "action_utterance"])
    mine, own = F.struct(*truth.columns), [c for c in e.columns if c not in ("call_id", "transcript")]
    at = ["call_id", "transcript"]
    # of events at one time the first counts; its speakers are all kept
    first = F.min("event_seq").over(W.partitionBy(*at, "peak_s"))
    heard = e.withColumn("first", first).where("event_seq = first").groupBy(*at, "peak_s").agg(F.sort_array(F.collect_set(F.struct(*own))).alias("events"))
    both = asked.select(*at, F.col("event_time_s").alias("t"), mine.alias("truth"), F.lit(None).cast(heard.schema["events"].dataType).alias("events"))
    both = both.unionByName(heard.select(*at, F.col("peak_s").alias("t"), "events"), allowMissingColumns=True)
    w = W.partitionBy(*at).orderBy("t")
    near = F.array_compact(F.array(F.last("events", True).over(w.rangeBetween(W.unboundedPreceding, 0)), F.first("events", True).over(w.rangeBetween(0, W.unboundedFollowing))))
    found = both.withColumn("near", F.array_distinct(F.flatten(near))).where("truth is not null").select("truth", "transcript", F.explode("near").alias("n"))
    return found.select("truth.*", "transcript", "n.*")


def judged(m: DataFrame, tolerance: float = 0.25, require_speaker: bool = False) -> DataFrame:
    """Per true event what the candidate got right; a hidden click is hit where no observed point is claimed."""
    c = F.col("cand")
    box = F.col("target_bbox")
    in_box = (c["px"] >= box[0]) & (c["px"] <= box[2]) & (c["py"] >= box[1]) & (c["py"] <= box[3])
    point = F.when(~F.col("observable"), c["grounding_status"] != "observed").when(box.isNotNull() & c["px"].isNotNull(), in_box).when(F.col("ui_target_text").isNotNull() & c["target_text"].isNotNull(), similarity(F.col("ui_target_text"), c["target_text"]) >= 0.7).otherwise(False)
    speaker = F.lit(True) if not require_speaker else F.col("speaker").isNull() | F.exists("heard", lambda h: (h["event_seq"] == c["event_seq"]) & (h["speaker"] == F.col("speaker")))
    yes = lambda x: F.coalesce(c.isNotNull() & x, F.lit(False)).cast("int")
    m = m.withColumns({"phrase": yes(F.lit(True)), "action_ok": yes(c["type"] == F.col("event_type")), "time_ok": yes(F.abs(c["peak_s"] - F.col("event_time_s")) <= tolerance), "point_ok": yes(point), "speaker_ok": yes(speaker)})
    off = F.when(F.col("point").isNotNull() & c["px"].isNotNull(), distance(F.col("point")[0], F.col("point")[1], c["px"], c["py"]))
    return m.withColumns({"all_ok": F.col("action_ok") * F.col("time_ok") * F.col("point_ok") * F.col("speaker_ok"), "off_px": off})


def scores(j: DataFrame, *by: str) -> DataFrame:
    """Shares over all true events, by call or for the corpus; nothing to average is NaN."""
    share = lambda c: nan_if_none(F.sum(c) / F.count("*"))
    return j.groupBy(*by).agg(share("all_ok").alias("all_right"), share("point_ok").alias("point_hit"), share("action_ok").alias("action_accuracy"), share("time_ok").alias("time_success"), share("phrase").alias("phrase_recall"), nan_if_none(F.avg("off_px")).alias("mean_px"), nan_if_none(F.percentile("off_px", F.lit(0.95))).alias("p95_px"), F.count("*").alias("n"))


def corpus_scores(j: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """One row for the corpus: scores() with the quantiles p50_px, p90_px and so on of the pixel errors, exact and without
    a task that holds all errors."""
    q = exact_quantiles(j, "off_px", points)
    one = q.agg(*[nan_if_none(F.max(F.when(F.col("point") == p, F.col("value")))).alias(f"p{round(p * 100)}_px") for p in points])
    share = lambda c: nan_if_none(F.sum(c) / F.count("*"))
    s = j.agg(share("all_ok").alias("all_right"), share("point_ok").alias("point_hit"), share("action_ok").alias("action_accuracy"), share("time_ok").alias("time_success"), share("phrase").alias("phrase_recall"), nan_if_none(F.avg("off_px")).alias("mean_px"), F.count("*").alias("n"))
    return s.withColumn("one", F.lit(1)).join(one.withColumn("one", F.lit(1)), "one").drop("one")


def factual_precision(events: DataFrame, *by: str) -> DataFrame:
    """D3: share of described events with evidence other than a model's claim and a status that is not inferred."""
    backed = F.exists("evidence", lambda e: e["source"] != "vlm_semantic") & (F.col("grounding_status") != "inferred")
    return events.groupBy(*by).agg(F.avg(backed.cast("double")).alias("factual_precision"))


def normal_token(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), U + r"[^\p{L}\p{Nd}]", "")


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """Pairs (key columns, ref array, hyp array) with wer: token edit distance over the reference's length.

    Each distinct token of a pair becomes one character, so that the built-in edit distance counts tokens; good for pairs of
    about 20,000 distinct tokens.
    """
    p = pairs.withColumns({"r": F.transform("ref", normal_token), "h": F.transform("hyp", normal_token)}).withColumn("d", F.array_distinct(F.concat("r", "h")))
    text = lambda a: F.array_join(F.transform(a, lambda t: F.decode(F.unhex(F.hex(F.array_position("d", t) + 0x4E00)), "UTF-16BE")), "")
    n = F.size("r")
    wer = F.when(n == 0, F.when(F.size("h") == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(text("r"), text("h")) / n)
    return p.withColumn("wer", wer).drop("r", "h", "d")


def follow(ref: list[tuple[str, float]], hyp: list[tuple[str, float]], ahead: int = 5) -> list[float]:
    """Start time errors of words matched in order, each within the next words of the hypothesis; a word without a match
    is passed over."""
    out, j = [], 0
    for token, start in ref:
        for k in range(j, min(len(hyp), j + ahead)):
            if hyp[k][0] == token:
                out.append(abs(hyp[k][1] - start))
                j = k + 1
                break
    return out


def word_times_off(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(call_id, error_s) of every matched word. Both: call_id, word_seq, word, start_s."""
    side = lambda d, s: d.select("call_id", F.lit(s).alias("side"), "word_seq", normal_token(F.col("word")).alias("token"), "start_s")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word_seq", kind="stable")
        of = lambda s: list(zip(rows.token[rows.side == s], rows.start_s[rows.side == s], strict=True))
        return pd.DataFrame({"call_id": rows.call_id.iloc[0], "error_s": follow(of(0), of(1))})

    return side(ref, 0).union(side(hyp, 1)).groupBy("call_id").applyInPandas(run, keyed("call_id long, error_s double", ref))


def word_time_errors(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per call MAE, median, P90, P95 and number of matched words. Both: call_id, word_seq, word, start_s."""
    e = word_times_off(ref, hyp)
    p = lambda q: nan_if_none(F.percentile("error_s", F.lit(q)))
    return e.groupBy("call_id").agg(nan_if_none(F.avg("error_s")).alias("mae"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.count("error_s").alias("n"))


def interval_recall(pred: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """C17: per call the share of true intervals (start_s, end_s) that a predicted one overlaps enough."""
    p = pred.select("call_id", F.col("start_s").alias("ps"), F.col("end_s").alias("pe"))
    near = overlapping(truth.select(*truth.columns).withColumn("truth_key", F.struct(*truth.columns)), p, ("start_s", "end_s"), ("ps", "pe"))
    near = near.where(interval_iou(F.col("ps"), F.col("pe"), F.col("start_s"), F.col("end_s")) >= threshold).select("call_id", "truth_key").distinct()
    return _share(truth, near)


def click_time_success(pred: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """C17: per call the share of true times with a predicted one within the tolerance."""
    wide = 2 * tolerance
    p = pred.select("call_id", F.col("time_s").alias("pt"), F.floor(F.col("time_s") / wide).alias("bucket")).distinct()
    t = truth.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("time_s") - tolerance) / wide), F.floor((F.col("time_s") + tolerance) / wide)))))
    near = t.join(p, ["call_id", "bucket"]).where(F.abs(F.col("pt") - F.col("time_s")) <= tolerance).select("call_id", "gt_idx").distinct()
    return _share(truth, near)


def _share(truth: DataFrame, hits: DataFrame) -> DataFrame:
    n, h = truth.groupBy("call_id").agg(F.count("*").alias("n")), hits.groupBy("call_id").agg(F.count("*").alias("hits"))
    return n.join(h, "call_id", "left").select("call_id", "n", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy("call_id").orderBy(*order)))
