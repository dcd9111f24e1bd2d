"""Queries over frames, model answers and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import frames as P
from ..operators import model_steps as M
from ..operators import targets
from ..sources import fixtures as X
from ..sources import frame_files
from ..streaming import ordered as O
from ..streaming import streams as Z
from .held import held, shared_root

QUERIES: dict = {}
ORACLES: dict = {}
WIDTH, HEIGHT, FPS = 64, 48, 4


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def frames(spark, d):
    """A10: gray frames drawn from the clicks: a frame each quarter second of the whole call; a light cursor wanders, and the
    screen half below changes at each click."""
    at = F.expr(f"explode(sequence(0, cast(floor(duration_s * {FPS}) as int)))")
    k = X.durations(spark, d).select("call_id", at.alias("k"))
    new = X.derived(spark, d, "clicks").groupBy("call_id", F.ceil(F.col("time_s") * FPS).cast("int").alias("k")).agg(F.count("*").alias("new"))
    so_far = F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy("call_id").orderBy("k"))
    g = k.join(new, ["call_id", "k"], "left").select("call_id", "k", so_far.alias("n")).sortWithinPartitions("call_id", "k")  # as the window leaves them

    def draw(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                out = []
                for call, k, n in zip(*(b[c].iloc[at : at + 1000].tolist() for c in ("call_id", "k", "n")), strict=True):
                    a = np.full((HEIGHT, WIDTH), 40, np.uint8)
                    a[24:40, 8:40] = 60 + 50 * (n % 4)
                    x, y = int(5 + (call * 7 + k // 6 * 3) % 50), int(2 + (call + k // 6) % 15)
                    a[y : y + 4, x : x + 3] = 230
                    out.append((call, k, k / FPS, WIDTH, HEIGHT, a.tobytes()))
                yield pd.DataFrame(out, columns=["call_id", "frame_idx", "pts_s", "width", "height", "pixels"])

    return g.mapInPandas(draw, "call_id long, frame_idx int, pts_s double, width int, height int, pixels binary")


def filed(spark, d, columns=()):
    """The frames of frames() written to files of calls, where they are drawn, and read from them."""
    path = f"{shared_root(spark).rstrip('/')}/frames-{uuid.uuid4().hex}"
    frame_files.write_frames(frames(spark, d), path, by_call=True).write.format("noop").mode("overwrite").save()
    return frame_files.frames(spark, path, columns).withColumn("call_id", F.col("call_id").cast("long"))


@query(f"with c as (select user_id as call_id, max({X.time_sql()}) + 1 as duration_s from events group by 1) select call_id, k::int as frame_idx, k::double / {FPS} as pts_s from c, range(0, (floor(duration_s * {FPS}) + 1)::bigint) t(k)")
def frame_times(spark, d):
    """A10: the times of all frames, read from files without their pixels"""
    return filed(spark, d, ("call_id", "frame_idx", "pts_s")).select("call_id", "frame_idx", "pts_s")


@query()
def frame_differences_from_files(spark, d):
    """A10, H1: from files of frames"""
    return P.frame_scores(filed(spark, d)).select("call_id", "frame_idx", "time_s", F.round("fraction", 6).alias("fraction"), "x1", "y1", "x2", "y2")


@query()
def frame_differences(spark, d):
    """A10, H1"""
    return P.frame_scores(frames(spark, d)).select("call_id", "frame_idx", "time_s", F.round("fraction", 6).alias("fraction"), "x1", "y1", "x2", "y2")


@query()
def cursor_by_motion(spark, d):
    """H2"""
    return P.cursor_track(frames(spark, d))


@query()
def cursor_by_template(spark, d):
    """H3"""
    t = np.full((4, 3), 230, np.uint8)
    return P.cursor_track(P.first_of_second(frames(spark, d)), t).withColumn("confidence", F.round("confidence", 6))


@query()
def key_frames(spark, d):
    """H4, H5, F3"""
    return P.key_frames(held(P.thumbnails(frames(spark, d), 32)), X.derived(spark, d, "clicks"))


@query()
def settled_screenshots(spark, d):
    """F4"""
    n = F.expr("row_number() over (partition by call_id order by time_s, vis_seq)")
    s = X.derived(spark, d, "clicks").select("call_id", n.alias("number"), "time_s", (F.col("time_s") + 2).alias("end_s"), (F.col("time_s") + 0.5).alias("screenshot_s"), (F.col("vis_seq") % 3 == 0).alias("has_click"))
    return P.settled_screenshots(s, held(P.thumbnails(frames(spark, d), 32)))


def _documents(spark, d):
    e = X.derived(spark, d, "elements")
    item = F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), "text", "text_confidence", "interactive_confidence", F.when(F.col("class") != "unknown", F.col("class")).alias("class"))
    return e.groupBy("call_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("element_seq", item.alias("i")))).getField("i").alias("elements"))).alias("body")).withColumn("time_s", F.lit(1.0))


@query(X.derived_sql("elements") + " select call_id, x1, y1, x2, y2, text, round(text_confidence, 6) as text_confidence, round(interactive_confidence, 6) as interactive_confidence, class from elements")
def ui_element_documents(spark, d):
    """A3"""
    return M.ui_elements(_documents(spark, d)).select("call_id", "x1", "y1", "x2", "y2", "text", F.round("text_confidence", 6).alias("text_confidence"), F.round("interactive_confidence", 6).alias("interactive_confidence"), "class")


@query(X.derived_sql("elements") + " select call_id, greatest(0, x1) as x1, greatest(0, y1) as y1, least(1000, x2) as x2, least(1000, y2) as y2, text, case when text is null then 0.0 else 0.95 end as text_confidence, case when interactive_confidence >= 0.5 then 0.85 else 0.2 end as interactive_confidence, class from elements where least(1000, x2) - greatest(0, x1) >= 2 and least(1000, y2) - greatest(0, y1) >= 2 and element_seq % 9 <> 0")
def ui_model_answers(spark, d):
    """A4: answers with prose around them, swapped corners, and some boxes of three numbers"""
    e = X.derived(spark, d, "elements")
    box = F.when(F.col("element_seq") % 9 == 0, F.array("x1", "y1", "x2")).when(F.col("element_seq") % 2 == 0, F.array("x2", "y2", "x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))
    item = F.struct("text", F.col("class").alias("type"), (F.col("interactive_confidence") >= 0.5).alias("interactive"), box.alias("box"))
    raw = e.groupBy("call_id").agg(F.concat(F.lit("Sure: "), F.to_json(F.struct(F.collect_list(item).alias("elements"))), F.lit(" Done.")).alias("raw"))
    return M.ui_answers(raw.select("call_id", F.lit(1.0).alias("time_s"), F.lit(1000).alias("width"), F.lit(1000).alias("height"), "raw")).drop("time_s", "det_seq")


@query(X.derived_sql("clicks") + " select call_id, vis_seq, round(time_s, 6) as time_s, 5 as x, 6 as y, 0.5 as confidence from clicks where vis_seq % 4 <> 0")
def pointing_answers(spark, d):
    """A5: fenced JSON, some broken"""
    e = X.derived(spark, d, "clicks")
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.lit("o").alias("object_id"), "time_s", F.lit(5).alias("x"), F.lit(6).alias("y"), F.lit(0.5).alias("confidence"))).alias("points"))), F.lit("\n```"))
    p = M.points(e.select("call_id", "vis_seq", F.when(F.col("vis_seq") % 4 == 0, "{points: oops").otherwise(good).alias("raw")))
    return p.select("call_id", "vis_seq", F.round("time_s", 6).alias("time_s"), "x", "y", "confidence")


def _refuse(rows: pd.DataFrame) -> pd.Series:
    if (rows.vis_seq % 3 == 0).any():
        raise RuntimeError("busy")
    return "seen " + rows.vis_seq.astype(str)


@query(X.derived_sql("clicks") + " select call_id, vis_seq, case when vis_seq % 3 = 0 then 'later' else 'seen ' || vis_seq end as answer, case when vis_seq % 3 = 0 then 'fallback' else 'ok' end as status, case when vis_seq % 3 = 0 then 'own not usable (busy)' end as note, case when vis_seq % 3 = 0 then 'spare' else 'own' end as model from clicks")
def services_with_fallback(spark, d):
    """J1, J2"""
    M.register("describer", "own", _refuse)
    M.register("describer", "spare", lambda rows: pd.Series("later", rows.index))
    return M.answered(X.derived(spark, d, "clicks").select("call_id", "vis_seq"), "describer", "own", "spare")


IOU = "(greatest(0, least(b.x2, n.x2) - greatest(b.x1, n.x1))::double * greatest(0, least(b.y2, n.y2) - greatest(b.y1, n.y1)))"
BOXES = X.derived_sql("elements").replace("with ", "with recursive ", 1) + f""",
 d as (select *, row_number() over (partition by call_id, time_s order by is_text desc, element_seq) as pos, (x2 - x1)::double * (y2 - y1) as area from (
  select call_id, floor(first_seen_s)::double as time_s, element_seq, true as is_text, x1, y1, x2, y2, text, text_confidence, 0.2e0 as interactive_confidence from elements where text is not null
  union all select call_id, floor(first_seen_s)::double, element_seq, false, x1 + 2, y1, x2, y2, null, 0, interactive_confidence from elements where element_seq % 2 = 0)),
 walk as (select distinct call_id, time_s, 0::bigint as pos, 0::bigint as owner, []::bigint[] as held from d
  union all select call_id, time_s, pos, case when joins then best else pos end, case when joins then held else list_append(held, pos) end
  from (select *, not is_text and coalesce(iou, 0) >= 0.5 as joins from (select w.call_id, w.time_s, n.pos, n.is_text, w.held, max({IOU} / (b.area + n.area - {IOU})) as iou, arg_max(b.pos, {IOU} / (b.area + n.area - {IOU}) - b.pos * 1e-9) as best
   from walk w join d n on w.call_id = n.call_id and w.time_s = n.time_s and n.pos = w.pos + 1 left join d b on b.call_id = n.call_id and b.time_s = n.time_s and list_contains(w.held, b.pos) group by w.call_id, w.time_s, n.pos, n.is_text, w.held)))"""


@query(BOXES + """ select b.call_id, b.time_s, b.x1, b.y1, b.x2, b.y2, b.text, b.text_confidence, max(m.interactive_confidence) as interactive_confidence
 from walk w join d m on w.call_id = m.call_id and w.time_s = m.time_s and w.pos = m.pos join d b on w.call_id = b.call_id and w.time_s = b.time_s and w.owner = b.pos group by b.call_id, b.time_s, b.pos, b.x1, b.y1, b.x2, b.y2, b.text, b.text_confidence""")
def merged_frame_boxes(spark, d):
    """C19"""
    e = X.derived(spark, d, "elements").select("call_id", F.floor("first_seen_s").cast("double").alias("time_s"), F.col("element_seq").alias("seq"), "x1", "y1", "x2", "y2", "text", "text_confidence", "interactive_confidence")
    moved = e.where("seq % 2 = 0").withColumn("x1", F.col("x1") + 2)
    return targets.merged_boxes(e.where("text is not null"), moved)


def _events(spark, d):
    return Z.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with s as (select user_id as call_id, epoch_us(ts)::double as time_s, (event_id % 100) / 1000 as fraction from events), n as (select *, lag(fraction) over w as before, lead(fraction) over w as after from s window w as (partition by call_id order by time_s))
 select call_id, time_s, fraction, least(0.98, greatest(0.3, fraction / 0.03e0))::double as confidence from n where fraction >= 0.0015 and (before is null or fraction >= before) and fraction > after""")
def stream_state_changes(spark, d):
    """I1"""
    e = _events(spark, d).select(F.col("user_id").alias("call_id"), F.unix_micros("ts").cast("double").alias("time_s"), ((F.col("event_id") % 100) / 1000).alias("fraction"))
    return Z.run_to_end(Z.state_changes(e))


@query("""with s as (select user_id as call_id, epoch_us(ts)::double as time_s, (event_id % 640)::int as x, (event_id % 480)::int as y, event_id % 9 as n, event_id % 9 >= 4 and event_id % 5 <> 0 as moved from events),
 l as (select *, last_value(case when moved then x end ignore nulls) over w as lx, last_value(case when moved then y end ignore nulls) over w as ly from s window w as (partition by call_id order by time_s rows unbounded preceding))
 select call_id, time_s, lx as x, ly as y, case when moved then 0.75e0 else 0.7e0 end as confidence from l where moved or (lx is not null and n < 4)""")
def stream_cursor(spark, d):
    """I2"""
    e = _events(spark, d).select(F.col("user_id").alias("call_id"), F.unix_micros("ts").cast("double").alias("time_s"), (F.col("event_id") % 640).cast("int").alias("x"), (F.col("event_id") % 480).cast("int").alias("y"), (F.col("event_id") % 9).cast("int").alias("n_pixels"), (F.col("event_id") % 5 != 0).alias("small"))
    return Z.run_to_end(Z.cursor_session(e))


IDLE_MS = 21_600_000
WAITED = """s as (select user_id as call_id, epoch_us(ts) as us, event_id, (event_id % 100) / 1000 as fraction from events), m as (select max(us) // 1000 - 10000 as wm from s), r as (select s.* from s, m where us <= wm * 1000)"""


def _ended(run, f):
    """What run makes of f's stream; the session's state store is then what it was."""
    spark = f.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    try:
        return Z.run_to_end(run(f, "10 seconds", IDLE_MS))
    finally:
        spark.conf.set(key, was)


@query(f"""with {WAITED}, n as (select *, lag(us) over w as bu, lead(us) over w as au, lag(fraction) over w as b, lead(fraction) over w as a from r window w as (partition by call_id order by us, fraction)),
 t as (select n.*, m.wm * 1000 > us + {IDLE_MS}000 and not exists (select 1 from s where s.call_id = n.call_id and s.us > m.wm * 1000) as over from n, m)
 select call_id, us::double as time_s, fraction, least(0.98, greatest(0.3, fraction / 0.03e0))::double as confidence from t where fraction >= 0.0015
 and (b is null or us - bu > {IDLE_MS}000 or fraction >= b) and case when au is null then over else au - us > {IDLE_MS}000 or fraction > a end""")
def stream_state_changes_in_order(spark, d):
    """What the watermark has passed, in order across batches; a call ends after six hours of silence"""
    return _ended(O.state_changes, _events(spark, d).select(F.col("user_id").alias("call_id"), "ts", F.unix_micros("ts").cast("double").alias("time_s"), ((F.col("event_id") % 100) / 1000).alias("fraction")))


@query(f"""with {WAITED}, g as (select *, (event_id % 640)::int as x, (event_id % 480)::int as y, event_id % 9 as n, event_id % 9 >= 4 and event_id % 5 <> 0 as moved,
  case when us - lag(us) over (partition by call_id order by us) > {IDLE_MS}000 then 1 else 0 end as new from r), k as (select *, sum(new) over (partition by call_id order by us) as part from g),
 l as (select *, last_value(case when moved then x end ignore nulls) over w as lx, last_value(case when moved then y end ignore nulls) over w as ly from k window w as (partition by call_id, part order by us rows unbounded preceding))
 select call_id, us::double as time_s, lx as x, ly as y, case when moved then 0.75e0 else 0.7e0 end as confidence from l where moved or (lx is not null and n < 4)""")
def stream_cursor_in_order(spark, d):
    """I2, I8"""
    e = _events(spark, d).select(F.col("user_id").alias("call_id"), "ts", F.unix_micros("ts").cast("double").alias("time_s"), (F.col("event_id") % 640).alias("x"), (F.col("event_id") % 480).alias("y"), (F.col("event_id") % 9).alias("n_pixels"), (F.col("event_id") % 5 != 0).alias("small"))
    return _ended(O.cursor_session, e)


@query("""select user_id as call_id, epoch_us(ts) // 1000000 as second_s, arg_min(event_id, epoch_us(ts)) as frame_idx from events group by 1, 2
 having (second_s + 1) * 1000 <= (select max(epoch_us(ts)) // 1000 - 10000 from events)""")
def stream_thumbnails(spark, d):
    """What the watermark has closed"""
    out = Z.run_to_end(Z.thumbnails(_events(spark, d).select(F.col("user_id").alias("call_id"), "ts", F.col("event_id").alias("frame_idx"))))
    return out.select("call_id", F.unix_seconds("second").alias("second_s"), "frame_idx")


@query("select a.user_id as call_id, a.event_id as ref_seq, b.event_id as vis_seq from events a join events b on a.user_id = b.user_id and a.event_type <> 'click' and b.event_type = 'click' and epoch_us(b.ts) - epoch_us(a.ts) between -30000000000 and 50000000000")
def stream_reference_clicks(spark, d):
    """I4: both sides on the time of the call"""
    at = F.timestamp_micros((F.unix_micros("ts") / 20000).cast("long"))
    e = _events(spark, d).withColumn("at", at)
    r = e.where("event_type <> 'click'").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ref_seq"), F.col("at").alias("anchor_ts"))
    c = e.where("event_type = 'click'").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("vis_seq"), F.col("at").alias("click_ts"))
    return Z.run_to_end(Z.references_to_clicks(r, c)).select("call_id", "ref_seq", "vis_seq")


@query("""with e as (select user_id as call_id, event_id, event_type = 'click' as click, epoch_us(ts) // 20000 as us from events),
 wm as (select min(us) // 1000 * 1000 - 10000000 as us from (select max(us) as us from e group by click)),
 p as (select a.call_id, a.event_id as ref_seq, a.us, b.event_id as vis_seq from e a left join e b on a.call_id = b.call_id and b.click and b.us - a.us between -1500000 and 2500000 where not a.click)
 select call_id, ref_seq, vis_seq from p where vis_seq is not null or us + 2500000 < (select us from wm)""")
def stream_all_references(spark, d):
    """References without a click too, once the watermark is past the last click that they could have"""
    at = F.timestamp_micros((F.unix_micros("ts") / 20000).cast("long"))
    e = _events(spark, d).withColumn("at", at)
    r = e.where("event_type <> 'click'").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ref_seq"), F.col("at").alias("anchor_ts"))
    c = e.where("event_type = 'click'").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("vis_seq"), F.col("at").alias("click_ts"))
    return Z.run_to_end(Z.references_to_clicks(r, c, how="leftOuter")).select("call_id", "ref_seq", "vis_seq")


@query()
def stream_elements(spark, d):
    """I5"""
    e = _events(spark, d).where("event_type = 'click'")
    box = {"x1": "(event_id * 37) % 1900", "y1": "(event_id * 53) % 1060", "x2": "(event_id * 37) % 1900 + 40", "y2": "(event_id * 53) % 1060 + 20"}
    det = e.select(F.col("user_id").alias("call_id"), F.unix_micros("ts").cast("double").alias("time_s"), F.col("event_id").alias("det_seq"), *[F.expr(f"cast({x} as int)").alias(c) for c, x in box.items()], F.lit(None).cast("string").alias("text"), F.lit(0.5).alias("text_confidence"), F.lit(0.5).alias("interactive_confidence"), F.lit("unknown").alias("class"))
    return Z.run_to_end(Z.elements(det))


@query("""with p as (select time_bucket(interval 15 minute, ts::timestamp) as pane, user_id, event_type from events), h as (select pane - k * interval 15 minute as hour, user_id, event_type from p, range(0, 4) t(k))
 select epoch_us(hour) // 1000000 as from_s, event_type as kind, count(*) as n, count(distinct user_id) as calls from h group by 1, 2
 having (from_s + 3600) * 1000000 <= (select max(epoch_us(ts)) // 1000 * 1000 - 3600000000 from events)""")
def stream_counters(spark, d):
    """What the watermark has closed"""
    out = Z.run_to_end(Z.counters(_events(spark, d).select(F.col("user_id").alias("call_id"), "ts", F.col("event_type").alias("kind"))))
    return out.select(F.unix_seconds("from_ts").alias("from_s"), "kind", "n", "calls")


@query("""with e as (select user_id as call_id, epoch_us(ts) // 20000 as us from events where event_type <> 'click'), n as (select *, case when us - lag(us) over w > 4050000 then 1 else 0 end as starts from e window w as (partition by call_id order by us)),
 s as (select *, sum(starts) over (partition by call_id order by us rows unbounded preceding) as part from n)
 select call_id, count(*) as n, min(us) - 1500000 as from_us, max(us) + 2500000 as to_us from s group by call_id, part having max(us) + 4050000 <= (select max(us) // 1000 * 1000 - 10000000 from e)""")
def stream_sessions(spark, d):
    """What the watermark has closed"""
    at = F.timestamp_micros((F.unix_micros("ts") / 20000).cast("long"))
    out = Z.run_to_end(Z.analysis_sessions(_events(spark, d).where("event_type <> 'click'").select(F.col("user_id").alias("call_id"), at.alias("anchor_ts"))))
    return out.select("call_id", "n", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))


@query("select event_id, user_id as call_id from events where case when event_type = 'click' then ts + interval 5 minute else ts end < (select max(ts) from events) - interval 60 minute")
def expired_calls(spark, d):
    """I8"""
    e = spark.read.parquet(f"{d}/events.parquet")
    now = e.agg(F.max("ts").alias("now"))
    jobs = e.select("event_id", F.col("user_id").alias("call_id"), F.col("ts").alias("created_ts"), F.when(F.col("event_type") == "click", F.col("ts") + F.expr("interval 5 minutes")).alias("finished_ts"))
    return Z.expired(jobs, now.first()["now"]).select("event_id", "call_id")
