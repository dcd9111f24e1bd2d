"""Gray frames: block differences, cursor tracks, thumbnails, key frames and settled screenshots; numpy over batches sorted by call.

A frame row is (call_id, frame_idx, pts_s, width, height, pixels); pixels are row-major bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlapping
from .keys import keyed

FRAME = ("call_id", "frame_idx", "pts_s", "width", "height", "pixels")
BLOCK, BLOCK_DIFF = 8, 12.0
SAME, CLICK_S = 2.5, 0.75


def image(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def block_difference(a: np.ndarray, b: np.ndarray) -> tuple[float, tuple[int, int, int, int] | None]:
    """Share of 8 by 8 blocks whose mean difference reaches the threshold, and the box around them."""
    h, w = a.shape[0] // BLOCK, a.shape[1] // BLOCK
    d = np.abs(a[: h * BLOCK, : w * BLOCK].astype(np.int32) - b[: h * BLOCK, : w * BLOCK])
    hit = d.reshape(h, BLOCK, w, BLOCK).mean(axis=(1, 3)) >= BLOCK_DIFF
    if not hit.any():
        return 0.0, None
    y, x = np.nonzero(hit)
    return float(hit.mean()), (int(x.min()) * BLOCK, int(y.min()) * BLOCK, int(x.max() + 1) * BLOCK, int(y.max() + 1) * BLOCK)


def _by_call(frames: DataFrame, start, schema: str, order: tuple[str, ...] = ("frame_idx",), cols: tuple[str, ...] = FRAME) -> DataFrame:
    """The rows that a call's own function, made by start, gives for each of its rows by order and for None at its end; rows stream
    through sorted, so a worker holds a batch of them and never a call."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        now, step = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if step is None or r.call_id != now:
                    out += step(None) if step else []
                    now, step = r.call_id, start()
                out += step(r)
            yield pd.DataFrame(out, columns=names)
        if step:
            yield pd.DataFrame(step(None), columns=names)

    return frames.select(*cols).repartition("call_id").sortWithinPartitions("call_id", *order).mapInPandas(run, keyed(schema, frames))


def frame_scores(frames: DataFrame) -> DataFrame:
    """H1: (call_id, frame_idx, time_s, fraction, x1, y1, x2, y2) of each frame against the one before; no change: the whole frame."""

    def start():
        prev = None

        def step(r) -> list[tuple]:
            nonlocal prev
            if r is None:
                return []
            before, prev = prev, image(r.pixels, r.width, r.height)
            if before is None:
                return []
            fraction, box = block_difference(before, prev)
            return [(r.call_id, r.frame_idx, r.pts_s, fraction, *(box or (0, 0, r.width, r.height)))]

        return step

    return _by_call(frames, start, "call_id long, frame_idx int, time_s double, fraction double, x1 int, y1 int, x2 int, y2 int")


def motion_blob(a: np.ndarray, b: np.ndarray, last: tuple | None, least: int = 4, most: int = 48, step: int = 40):
    """(position, sample) after a frame pair: a small bright blob that appeared moves the cursor, stillness keeps it."""
    y, x = np.nonzero(b.astype(np.int32) - a >= step)
    if len(x) >= least and x.max() - x.min() <= most and y.max() - y.min() <= most:
        last = (int(x.min()), int(y.min()))
        return last, (*last, 0.75)
    return last, (*last, 0.7) if last is not None and len(x) < least else None


def best_match(frame: np.ndarray, template: np.ndarray, x0: int, y0: int, x1: int, y1: int, step: int) -> tuple[int, int, float]:
    """Place of the least mean difference, on a grid and then around its best point."""
    th, tw = template.shape
    t = template.astype(np.int32)

    places = np.lib.stride_tricks.sliding_window_view(frame, (th, tw)) if frame.shape[0] >= th and frame.shape[1] >= tw else None

    def scan(ys, xs, best):
        if places is None or not ys or not xs:
            return best
        errors = np.abs(places[ys.start : ys.stop : ys.step, xs.start : xs.stop : xs.step] - t).mean(axis=(2, 3))
        k, j = divmod(int(errors.argmin()), len(xs))
        e = float(errors[k, j])
        return (xs[j], ys[k], e) if e < best[2] else best

    best = scan(range(y0, y1 + 1, step), range(x0, x1 + 1, step), (-1, -1, float("inf")))
    if step > 1 and best[0] >= 0:
        x, y, _ = best
        best = scan(range(max(y0, y - step), min(y1, y + step) + 1), range(max(x0, x - step), min(x1, x + step) + 1), best)
    return best


CURSOR = "call_id long, sample_seq int, time_s double, x int, y int, confidence double"


def cursor_track(frames: DataFrame, template: np.ndarray | None = None, most_error: float = 18.0, radius: int = 120) -> DataFrame:
    """H2, H3: cursor samples of each call, by moving blob or by template."""

    def start():
        prev, last = None, None

        def step(r) -> list[tuple]:
            nonlocal prev, last
            if r is None:
                return []
            now, sample = image(r.pixels, r.width, r.height).astype(np.int32), None
            if template is not None:
                x1, y1 = r.width - template.shape[1], r.height - template.shape[0]
                near = (0, 0, x1, y1) if last is None else (max(0, last[0] - radius), max(0, last[1] - radius), min(x1, last[0] + radius), min(y1, last[1] + radius))
                x, y, e = best_match(now, template, *near, 2)
                if e > most_error and last is not None:
                    x, y, e = best_match(now, template, 0, 0, x1, y1, 3)
                last = (x, y) if e <= most_error else None
                sample = (x, y, min(0.98, max(0.2, 1 - e / most_error))) if last else None
            elif prev is not None:
                last, sample = motion_blob(prev, now, last)
            prev = now
            return [(r.call_id, r.frame_idx, r.pts_s, *sample)] if sample else []

        return step

    return _by_call(frames, start, CURSOR)


def first_of_second(frames: DataFrame) -> DataFrame:
    """H4: the first frame of each whole second."""
    w = W.partitionBy("call_id", F.floor("pts_s")).orderBy("frame_idx")
    return frames.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def shrunk(a: np.ndarray, width: int) -> np.ndarray:
    """Box-filtered to width, each pixel the mean of its area; narrower frames stay."""
    h, w = a.shape
    if w <= width:
        return a
    height = max(2, round(h * width / w / 2) * 2)
    sums = np.pad(np.cumsum(np.cumsum(a.astype(np.int64), axis=0), axis=1), ((1, 0), (1, 0)))
    edge = lambda n, full: (np.arange(n) * full // n, np.maximum(np.arange(n) * full // n + 1, (np.arange(n) + 1) * full // n))
    (y0, y1), (x0, x1) = edge(height, h), edge(width, w)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return (total // ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.uint8)


def thumbnails(frames: DataFrame, width: int = 160) -> DataFrame:
    """H4: thumbnails of the first frame of each second."""
    schema = "call_id long, frame_idx int, pts_s double, width int, height int, pixels binary"

    def run(batches):
        for b in batches:
            small = [shrunk(image(r.pixels, r.width, r.height), width) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"call_id": b.call_id, "frame_idx": b.frame_idx, "pts_s": b.pts_s, "width": [s.shape[1] for s in small], "height": [s.shape[0] for s in small], "pixels": [s.tobytes() for s in small]})

    return first_of_second(frames).select("call_id", "frame_idx", "pts_s", "width", "height", "pixels").mapInPandas(run, keyed(schema, frames))


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """H5: mean absolute difference; 255 where the sizes differ."""
    return 255.0 if a.shape != b.shape else float(np.abs(a.astype(np.int32) - b).mean())


def thumbnail_changes(thumbs: DataFrame) -> DataFrame:
    """H5 along a call: (call_id, frame_idx, pts_s, change) of each thumbnail against the one before; the first has none."""

    def start():
        prev = None

        def step(r) -> list[tuple]:
            nonlocal prev
            if r is None:
                return []
            before, prev = prev, image(r.pixels, r.width, r.height)
            return [(r.call_id, r.frame_idx, r.pts_s, None if before is None else difference(prev, before))]

        return step

    return _by_call(thumbs, start, "call_id long, frame_idx int, pts_s double, change double")


def key_frame_scores(thumbs: DataFrame, clicks: DataFrame) -> DataFrame:
    """(call_id, frame_idx, score) of the frames that can be key frames: the first, those that changed and settled, and those
    with a click at most 0.75 s away; clicks and large changes score higher. Pixels are read in the first step only; the
    nearest clicks on both sides are running ends over times."""
    c = thumbnail_changes(thumbs).withColumn("moving", F.coalesce(F.lead("change").over(W.partitionBy("call_id").orderBy("frame_idx")), F.lit(0.0)))
    both = c.select("call_id", F.col("pts_s").alias("t"), F.lit(None).cast("double").alias("click"), "frame_idx", "change", "moving").unionByName(
        clicks.select("call_id", F.col("time_s").cast("double").alias("t"), F.col("time_s").cast("double").alias("click")), allowMissingColumns=True)
    before, after = F.max("click").over(W.partitionBy("call_id").orderBy("t")), F.min("click").over(W.partitionBy("call_id").orderBy(F.col("t").desc()))
    near = F.coalesce((F.col("t") - F.col("before") <= CLICK_S) | (F.col("after") - F.col("t") <= CLICK_S), F.lit(False))
    d = both.withColumn("before", before).withColumn("after", after).where("frame_idx is not null").withColumn("near", near)
    score = F.when(F.col("change").isNull(), 50.0).when(F.col("near") | ((F.col("change") >= SAME) & (F.col("moving") < 2 * SAME)), F.col("change") + F.when(F.col("near"), 100.0).otherwise(0.0))
    return d.select("call_id", "frame_idx", score.alias("score")).where("score is not null")


def key_frames(thumbs: DataFrame, clicks: DataFrame, most: int = 12) -> DataFrame:
    """(call_id, frame_idx, pts_s): at most most frames of a call that differ and lie two seconds apart, those of higher score
    first, of equal scores the earlier. clicks: call_id, time_s; without any only changes count.

    Candidates meet their pixels again and stream through by falling score: a worker holds the frames taken in one call, most of
    them. thumbs is read twice, so it should be a table.
    """

    def start():
        taken: list[tuple[float, np.ndarray]] = []

        def step(r) -> list[tuple]:
            if r is None or len(taken) >= most:
                return []
            now = image(r.pixels, r.width, r.height)
            if any(abs(t - r.pts_s) < 2 or difference(a, now) < SAME for t, a in taken):
                return []
            taken.append((r.pts_s, now.copy()))
            return [(r.call_id, r.frame_idx, r.pts_s)]

        return step

    found = key_frame_scores(thumbs, clicks).withColumn("place", -F.col("score"))
    return _by_call(thumbs.join(found, ["call_id", "frame_idx"]), start, "call_id long, frame_idx int, pts_s double", ("place", "frame_idx"), (*FRAME, "place"))


def settled_screenshots(steps: DataFrame, thumbs: DataFrame) -> DataFrame:
    """(call_id, number, screenshot_s) of each step (call_id, number, time_s, end_s, screenshot_s, has_click): of the thumbnails
    in its span the one that is settled and differs most from the step before, none if it looks the same. Clicks keep their time,
    and a step without thumbnails too.

    Steps meet the times in their span (15 s at most) first, then those pixels; they stream through by step and time, so a worker
    holds three thumbnails: of the step before, the best so far, and the one whose next isn't known yet. Spark can't tell how many
    frames come from a row of their source, so it is told to merge, or it would send their times to the driver as a small table.
    """
    low = F.when(F.col("has_click"), F.col("screenshot_s")).otherwise(F.col("time_s"))
    high = F.when(F.col("has_click"), F.col("screenshot_s") + 0.5).otherwise(F.least(F.greatest("end_s", F.col("time_s") + 1) + 1, F.col("time_s") + 15))
    s = steps.select("call_id", "number", F.col("screenshot_s").cast("double").alias("shot"), F.coalesce("has_click", F.lit(False)).alias("click"), low.alias("low"), high.alias("high"))
    own = overlapping(s.select("call_id", "number", "low", "high"), thumbs.select("call_id", "frame_idx", "pts_s").hint("merge"), ("low", "high"), ("pts_s", "pts_s"), 16.0).select("call_id", "number", "frame_idx")
    rows = s.join(own.join(thumbs.hint("merge"), ["call_id", "frame_idx"]).hint("merge"), ["call_id", "number"], "left")

    def start():
        prev = now = best = pending = None

        def rate(following: np.ndarray | None) -> None:
            nonlocal best
            at, a = pending
            moving = 0.0 if following is None else difference(a, following)
            new = 255.0 if prev is None else difference(a, prev)
            value = min(new, 40) - 2 * moving - (0.0 if pd.isna(now.shot) else 0.05 * abs(at - now.shot))
            if best is None or value > best[0]:
                best = (value, at, a, new)

        def close() -> list[tuple]:
            nonlocal prev
            shot = None if pd.isna(now.shot) else now.shot
            if now.click:
                prev = pending[1] if pending else prev
            elif pending:
                rate(None)
                same = prev is not None and best[3] < SAME
                prev, shot = (prev, None) if same else (best[2], best[1])
            return [(now.call_id, now.number, shot)]

        def step(r) -> list[tuple]:
            nonlocal now, best, pending
            out = []
            if now is not None and (r is None or r.number != now.number):
                out, best, pending = close(), None, None
            now = r
            if r is not None and r.pixels is not None and not (r.click and pending):  # a click looks at its first thumbnail only
                a = image(r.pixels, int(r.width), int(r.height)).copy()
                if pending:
                    rate(a)
                pending = (r.pts_s, a)
            return out

        return step

    return _by_call(rows, start, "call_id long, number int, screenshot_s double", ("number", "pts_s", "frame_idx"), ("call_id", "number", "shot", "click", "pts_s", "frame_idx", "width", "height", "pixels"))
