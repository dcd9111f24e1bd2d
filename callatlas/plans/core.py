"""Queries of the relational core: fusion, targets, clicks, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import clicks, fusion, targets
from ..sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}
ACTION, DEICTIC, TARGET = X.meaning_sql()


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def references(spark, d) -> DataFrame:
    """Instructions as references: the text is parsed, those without an action are left out."""
    t = F.col("text")
    r = X.derived(spark, d, "instructions").withColumns({"spoken_action": T.action(t), "deictic": T.is_deictic(t), "explicit_target": T.explicit_target(t), "ordinal": F.lit(0)})
    return r.where("spoken_action <> 'unknown'")


def events(spark, d) -> DataFrame:
    """Clicks with spans and evidence."""
    e = X.derived(spark, d, "clicks")
    ev = lambda s, c: F.struct(F.lit(s).alias("source"), F.col(c).alias("confidence"))
    strong = F.struct(F.col("point_source").alias("source"), F.col("detector_confidence").alias("confidence"))
    return e.withColumns({"start_s": F.col("time_s") - 0.2, "end_s": F.col("time_s") + 0.1, "evidence": F.when(F.col("point_source").isNull(), F.array(ev("frame_state_change", "state_change_confidence"))).otherwise(F.array(strong, ev("frame_state_change", "state_change_confidence")))})


REFS = f"""refs as (select *, {ACTION} as spoken_action, {DEICTIC} as deictic, {TARGET} as explicit_target from instructions where {ACTION} <> 'unknown')"""
PAIRS = """pairs as (select r.call_id, r.ref_seq, c.vis_seq, r.anchor_s, c.time_s, r.spoken_action, c.action, r.explicit_target, c.x, c.ui_interactive_confidence, c.state_change_confidence, c.detector_confidence
  from refs r join clicks c on r.call_id = c.call_id and c.time_s >= r.anchor_s - 1.5 and c.time_s <= r.anchor_s + 2.5)"""
CLICKY = "('click','double_click','right_click','tap','select')"
SEMANTIC = f"case when spoken_action = action then 1.0 when spoken_action = 'unknown' or action = 'unknown' then 0.5 when spoken_action in {CLICKY} and action in {CLICKY} then 0.7 when spoken_action = 'point' and action in {CLICKY} then 0.5 else 0.25 end"
SCORED = f"""scored as (select *, least(1, greatest(0, 0.35e0 * exp(-abs(time_s - anchor_s) / 0.75e0) + 0.2e0 * ({SEMANTIC}) + 0.15e0 * (case when x is not null then 1.0 else 0.2 end) + 0.15e0 * ui_interactive_confidence + 0.15e0 * state_change_confidence)) * detector_confidence as score from pairs)"""
#: One-to-one matching, best score first: a pair is taken where neither side is; the lists are what earlier pairs took.
BOUND = """ranked as (select *, row_number() over (partition by call_id order by score desc, ref_seq, vis_seq) as k from scored where score >= 0.35),
 walk as (select distinct call_id, 0::bigint as k, []::bigint[] as heard, []::bigint[] as seen, false as took from ranked
  union all
  select r.call_id, r.k, case when free then list_append(heard, r.ref_seq) else heard end, case when free then list_append(seen, r.vis_seq) else seen end, free
  from (select w.heard, w.seen, r.call_id, r.k, r.ref_seq, r.vis_seq, not list_contains(w.heard, r.ref_seq) and not list_contains(w.seen, r.vis_seq) as free from walk w join ranked r on w.call_id = r.call_id and r.k = w.k + 1) r),
 bound as (select r.call_id, r.ref_seq, r.vis_seq, r.score from ranked r join walk w using (call_id, k) where took)"""


def rounded(x: str) -> str:
    """Three digits, half to even, of the shortest decimal form of a double."""
    d = f"({x})::varchar::decimal(30, 18) * 1000"
    return f"((case when {d} - floor({d}) > 0.5 or ({d} - floor({d}) = 0.5 and floor({d})::bigint % 2 = 1) then floor({d}) + 1 else floor({d}) end)::double / 1000)"


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


BASE = X.derived_sql("instructions", "clicks") + ",\n" + REFS + ",\n" + PAIRS + ",\n" + SCORED


@query(X.derived_sql("instructions") + f" select call_id, ref_seq, {ACTION} as spoken_action, {DEICTIC} as deictic, {TARGET} as explicit_target from instructions")
def instruction_parse(spark, d):
    """B3, B4, B5"""
    t = F.col("text")
    return X.derived(spark, d, "instructions").select("call_id", "ref_seq", T.action(t).alias("spoken_action"), T.is_deictic(t).alias("deictic"), T.explicit_target(t).alias("explicit_target"))


@query(BASE + " select call_id, ref_seq, vis_seq, round(time_s - anchor_s, 6) as lag_s from pairs")
def reference_click_window(spark, d):
    """C1"""
    return fusion.in_window(references(spark, d), events(spark, d)).select("call_id", "ref_seq", "vis_seq", F.round(F.col("time_s") - F.col("anchor_s"), 6).alias("lag_s"))


@query(BASE + " select call_id, ref_seq, vis_seq, round(score, 6) as score from scored where score >= 0.35")
def association_scores(spark, d):
    """B10, C2"""
    r, e = references(spark, d).drop("start_s", "speaker", "text"), events(spark, d)
    return fusion.candidates(r, e).select("call_id", "ref_seq", "vis_seq", F.round("score", 6).alias("score"))


def bound(spark, d) -> DataFrame:
    r, e = references(spark, d), events(spark, d)
    return fusion.resolve(fusion.candidates(r.drop("text", "speaker"), e.drop("start_s", "end_s", "evidence")))


@query(recursive(BASE + ",\n" + BOUND + " select call_id, ref_seq, vis_seq, round(score, 6) as score from bound"))
def associations(spark, d):
    """C3"""
    return bound(spark, d).select("call_id", "ref_seq", "vis_seq", F.round("score", 6).alias("score"))


@query(recursive(BASE + ",\n" + BOUND + """, n as (select call_id, count(*) as n_references, count(distinct speaker) as n_speakers from refs group by 1), v as (select call_id, count(*) as n_events from clicks group by 1),
 b as (select call_id, count(*) as n_bound, round(avg(score), 6) as mean_score from bound group by 1)
 select call_id, coalesce(n_references, 0) as n_references, coalesce(n_speakers, 0) as n_speakers, coalesce(n_events, 0) as n_events, coalesce(n_bound, 0) as n_bound, coalesce(n_references, 0) - coalesce(n_bound, 0) as n_unbound, mean_score from n full join v using (call_id) left join b using (call_id)"""))
def call_binding_summary(spark, d):
    """D7 with C3, C14, C15: per call the references, events, bindings, unbound references and mean score."""
    r, e, b = references(spark, d), events(spark, d), bound(spark, d)
    n = r.groupBy("call_id").agg(F.count("*").alias("n_references"), F.countDistinct("speaker").alias("n_speakers"))
    v = e.groupBy("call_id").agg(F.count("*").alias("n_events"))
    k = b.groupBy("call_id").agg(F.count("*").alias("n_bound"), F.round(F.avg("score"), 6).alias("mean_score"))
    j = n.join(v, "call_id", "full").join(k, "call_id", "left")
    return j.select("call_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_references", "n_speakers", "n_events", "n_bound")], (F.coalesce("n_references", F.lit(0)) - F.coalesce("n_bound", F.lit(0))).alias("n_unbound"), "mean_score")


@query(recursive(BASE + ",\n" + BOUND + " select call_id, ref_seq, spoken_action, 'no_visual_event_found' as relation from refs anti join bound using (call_id, ref_seq)"))
def unbound_references(spark, d):
    """C15"""
    return fusion.unbound(references(spark, d), bound(spark, d)).select("call_id", "ref_seq", "spoken_action", fusion.relation(F.col("deictic"), F.lit(False)).alias("relation"))


EVIDENCE = "case when point_source is null or point_source = 'vlm_pointing' then case when x is null then 0 else state_change_confidence end when point_source in ('telemetry','cursor_tracker','frame_state_change','sam2') then greatest(detector_confidence, state_change_confidence) end"


@query(X.derived_sql("clicks") + f""" select call_id, vis_seq, case when x is null then 'unobservable' when point_source in ('telemetry','cursor_tracker','frame_state_change') then 'observed' when point_source = 'sam2' then 'tracked' else 'inferred' end as grounding_status,
  round({EVIDENCE}, 6) as spatial_confidence, round(least(1, greatest(0, 0.6e0 * detector_confidence + 0.4e0 * state_change_confidence)), 6) as temporal_confidence from clicks""")
def event_confidences(spark, d):
    """B11, D9"""
    e = fusion.confidences(events(spark, d).withColumn("association_score", F.lit(None).cast("double")))
    return e.select("call_id", "vis_seq", fusion.grounding_status(F.col("x").isNotNull(), F.col("point_source")).alias("grounding_status"), F.round("spatial_confidence", 6).alias("spatial_confidence"), F.round("temporal_confidence", 6).alias("temporal_confidence"))


ELEMENT_AT = """select call_id, vis_seq, element_seq from (
  select c.call_id, c.vis_seq, e.element_seq, row_number() over (partition by c.call_id, c.vis_seq order by case when e.interactive_confidence >= 0.5 then 0 else 1 end, (e.x2 - e.x1)::bigint * (e.y2 - e.y1), e.element_seq) as k
  from clicks c join elements e on c.call_id = e.call_id and c.x between e.x1 and e.x2 and c.y between e.y1 and e.y2 and e.first_seen_s - {tol} <= c.time_s + {shift} and c.time_s + {shift} <= e.last_seen_s + {tol}) where k = 1"""


@query(X.derived_sql("clicks", "elements") + f", early as ({ELEMENT_AT.format(tol='0.6e0', shift='(-0.3e0)')}), late as ({ELEMENT_AT.format(tol='1.0e0', shift='0.0e0')}) select c.call_id, c.vis_seq, coalesce(early.element_seq, late.element_seq) as target_seq from clicks c left join early using (call_id, vis_seq) left join late using (call_id, vis_seq)")
def point_targets(spark, d):
    """C4"""
    return targets.targets_at_points(events(spark, d), X.derived(spark, d, "elements")).select("call_id", "vis_seq", "target_seq")


GRAPH = (BASE + ", elements as (" + X.derived_sql("elements").split(" as (", 1)[1] + ",\n" + BOUND + f", early as ({ELEMENT_AT.format(tol='0.6e0', shift='(-0.3e0)')}), late as ({ELEMENT_AT.format(tol='1.0e0', shift='0.0e0')})," + f"""
 c as (select c.*, coalesce(early.element_seq, late.element_seq) as target_seq, b.ref_seq, b.score, case when x is null then 'unobservable' when point_source in ('telemetry','cursor_tracker','frame_state_change') then 'observed' when point_source = 'sam2' then 'tracked' else 'inferred' end as grounding_status,
  case when x is null then 0 else coalesce({EVIDENCE}, 0.4) end as spatial, least(1, greatest(0, 0.6e0 * detector_confidence + 0.4e0 * state_change_confidence)) as temporal, row_number() over (partition by c.call_id order by c.time_s, c.vis_seq) - 1 as n
  from clicks c left join early using (call_id, vis_seq) left join late using (call_id, vis_seq) left join bound b using (call_id, vis_seq)),
 g as (select *, {rounded('(case when score is null then 0.5e0 * temporal + 0.5e0 * spatial else 0.4e0 * score + 0.3e0 * temporal + 0.3e0 * spatial end)')} as overall_confidence from c)""")


@query(recursive(GRAPH + """ select call_id, vis_seq, printf('event_%04d', n) as event_id, action as type, ROUNDED_TIME as peak_s, case when x is not null then [x, y] end as point_xy_px, case when target_seq is not null then printf('ui_%03d', target_seq) end as object_id,
 case when ref_seq is null then 0 else 1 end as n_references, grounding_status, overall_confidence from g""".replace("ROUNDED_TIME", rounded("time_s"))))
def event_graph(spark, d):
    """Grounded events with targets"""
    e = targets.targets_at_points(events(spark, d), X.derived(spark, d, "elements"))
    g = fusion.grounded_events(e, bound(spark, d), references(spark, d), X.derived(spark, d, "elements"), X.WIDTH, X.HEIGHT)
    return g.select("call_id", "vis_seq", "event_id", "type", F.col("temporal.peak_s").alias("peak_s"), F.col("spatial.point_xy_px").alias("point_xy_px"), F.col("target.object_id").alias("object_id"), F.size("audio_references").alias("n_references"), "grounding_status", "overall_confidence")


@query(X.derived_sql("instructions", "elements") + ",\n" + REFS + """, p as (select r.call_id, r.ref_seq, e.element_seq, 1 - levenshtein(lower(explicit_target), lower(e.text)) / greatest(length(explicit_target), length(e.text))::double as sim
  from refs r join elements e on r.call_id = e.call_id and r.explicit_target is not null and e.text is not null and e.first_seen_s - 2 <= r.anchor_s and r.anchor_s <= e.last_seen_s + 2)
  select call_id, ref_seq, element_seq, round(sim, 6) as sim from (select *, row_number() over (partition by call_id, ref_seq order by sim desc, element_seq) as k from p where sim >= 0.6) where k = 1""")
def spoken_target_elements(spark, d):
    """B7, C5"""
    return targets.spoken_targets(references(spark, d), X.derived(spark, d, "elements")).select("call_id", "ref_seq", "element_seq", F.round("sim", 6).alias("sim"))


@query(X.derived_sql("instructions", "clicks", "elements") + ",\n" + REFS + f", early as ({ELEMENT_AT.format(tol='0.6e0', shift='(-0.3e0)')}), late as ({ELEMENT_AT.format(tol='1.0e0', shift='0.0e0')})," + """
 p as (select r.call_id, r.ref_seq, r.anchor_s, e.element_seq, 1 - levenshtein(lower(explicit_target), lower(e.text)) / greatest(length(explicit_target), length(e.text))::double as sim
  from refs r join elements e on r.call_id = e.call_id and r.explicit_target is not null and e.text is not null and e.first_seen_s - 2 <= r.anchor_s and r.anchor_s <= e.last_seen_s + 2),
 said as (select call_id, ref_seq, anchor_s, element_seq from (select *, row_number() over (partition by call_id, ref_seq order by sim desc, element_seq) as k from p where sim >= 0.6) where k = 1),
 c as (select c.call_id, c.vis_seq, c.time_s, c.point_source, coalesce(early.element_seq, late.element_seq) as target_seq from clicks c left join early using (call_id, vis_seq) left join late using (call_id, vis_seq)),
 near as (select c.call_id, c.vis_seq, arg_min(said.element_seq, said.ref_seq) as spoken_seq from c join said on c.call_id = said.call_id and c.target_seq is null and abs(c.time_s - said.anchor_s) <= 2.5 group by 1, 2)
 select call_id, vis_seq, coalesce(target_seq, spoken_seq) as target_seq, case when point_source is null then 1 else 2 end + case when spoken_seq is null then 0 else 1 end as n_evidence from c left join near using (call_id, vis_seq)""")
def events_with_spoken_targets(spark, d):
    """Targets by point, then by the spoken word"""
    el = X.derived(spark, d, "elements")
    e = targets.assign_spoken_targets(targets.targets_at_points(events(spark, d), el), targets.spoken_targets(references(spark, d), el))
    return e.select("call_id", "vis_seq", "target_seq", F.size("evidence").alias("n_evidence"))


@query("""with s as (select l_suppkey as call_id, l_discount::double as fraction, lag(l_discount::double) over w as before, lead(l_discount::double) over w as after, row_number() over w as frame_no
  from lineitem window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice))
  select call_id, frame_no, fraction, least(0.98, greatest(0.3, fraction / 0.03e0))::double as confidence, fraction >= 0.6 as scene_cut from s
  where fraction >= 0.0015 and (before is null or fraction >= before) and (after is null or fraction > after)""")
def state_changes(spark, d):
    """E1, E2"""
    s = X.frame_scores(spark, d).withColumn("frame_no", F.row_number().over(W.partitionBy("call_id").orderBy("frame_key")))
    return clicks.state_changes(s, ["frame_key"]).select("call_id", "frame_no", "fraction", F.round("confidence", 9).alias("confidence"), "scene_cut")


MOTION = """moved as (select c.call_id, c.change_seq, s.time_s as at_s, s.x as cx, s.y as cy, c.x1, c.y1, c.x2, c.y2, s.px, s.py,
    row_number() over (partition by c.call_id, c.change_seq order by abs(s.time_s - c.time_s), s.time_s, s.sample_seq) as k
  from changes c join (select a.*, p.x as px, p.y as py from cursor a asof left join cursor p on a.call_id = p.call_id and a.time_s - 1e-6 > p.time_s) s on c.call_id = s.call_id and abs(s.time_s - c.time_s) <= 0.11e0
  where greatest(c.x2 - c.x1, c.y2 - c.y1) <= 96),
motion as (select call_id, change_seq from moved where k = 1 and (px is null or (sqrt((cx - px)^2 + (cy - py)^2) > 2 and cx between x1 - 8 and x2 + 8 and cy between y1 - 8 and y2 + 8)))"""


@query(X.derived_sql("changes", "cursor") + ",\n" + MOTION + " select * from motion")
def cursor_motion(spark, d):
    """C7"""
    return clicks.cursor_motion(X.derived(spark, d, "changes"), X.derived(spark, d, "cursor"))


@query(X.derived_sql("changes", "cursor") + ",\n" + MOTION + """,
n as (select c.call_id, c.change_seq, s.time_s as at_s, s.sample_seq, s.x as cx, s.y as cy, s.confidence as cc from changes c join cursor s on c.call_id = s.call_id and s.time_s <= c.time_s + 1e-6 and s.time_s >= c.time_s - 0.72e0),
l as (select *, last_value(at_s) over w as la, last_value(cx) over w as lx, last_value(cy) over w as ly, last_value(cc) over w as lc from n window w as (partition by call_id, change_seq order by at_s, sample_seq rows between unbounded preceding and unbounded following)),
b as (select *, max(case when la - at_s > 0 and sqrt((cx - lx)^2 + (cy - ly)^2) / (la - at_s) > 60 then (at_s, sample_seq) end) over (partition by call_id, change_seq) as broken from l),
g as (select call_id, change_seq, any_value(la) as la, any_value(lx) as lx, any_value(ly) as ly, any_value(lc) as lc, min(case when broken is null or (at_s, sample_seq) > broken then at_s end) as from_s from b group by all)
select c.call_id, c.change_seq, lx as x, ly as y, case when la is null then 0.5e0 * c.confidence else 0.5e0 * lc + 0.3e0 * (case when la - from_s >= 0.12e0 then 1 else 0.4 end) + 0.2e0 * (case when lx between c.x1 and c.x2 and ly between c.y1 and c.y2 then 1 else 0.5 end) end as detector_confidence
from changes c left join g using (call_id, change_seq) left join (select distinct call_id, true as has_cursor from cursor) h using (call_id)
where (c.call_id, c.change_seq) not in (select call_id, change_seq from motion) and not (c.magnitude >= 0.6 and has_cursor is null)""")
def click_candidates(spark, d):
    """C6, C7, E6, E7"""
    e = clicks.click_candidates(X.derived(spark, d, "changes"), X.derived(spark, d, "cursor"))
    return e.select("call_id", "change_seq", "x", "y", F.round("detector_confidence", 9).alias("detector_confidence"))


@query(X.derived_sql("clicks") + ", c as (select * from clicks where vis_seq % 2 = 0), f as (select * from clicks where vis_seq % 2 = 1) select call_id, vis_seq, round(time_s, 6) as time_s from c where not exists (select 1 from f where f.call_id = c.call_id and abs(f.time_s - c.time_s) <= 0.35e0) union all select call_id, vis_seq, round(time_s, 6) from f")
def fine_over_coarse(spark, d):
    """C8, G2"""
    e = X.derived(spark, d, "clicks").select("call_id", "vis_seq", "time_s")
    return clicks.fine_over_coarse(e.where("vis_seq % 2 = 0"), e.where("vis_seq % 2 = 1")).select("call_id", "vis_seq", F.round("time_s", 6).alias("time_s"))


@query(X.derived_sql("instructions") + f""", d as (select user_id as call_id, max({X.time_sql()}) + 1 as duration_s from events group by 1),
 s as (select call_id, greatest(anchor_s - 1.5e0, 0) as a, least(anchor_s + 2.5e0, duration_s) as b from instructions join d using (call_id)), t as (select * from s where b > a),
 r as (select *, max(b) over (partition by call_id order by a, b rows between unbounded preceding and 1 preceding) as reach from t),
 i as (select *, sum(case when reach is null or a > reach + 0.05e0 then 1 else 0 end) over (partition by call_id order by a, b rows unbounded preceding) as island from r)
 select call_id, round(min(a), 6) as from_s, round(max(b), 6) as to_s from i group by call_id, island""")
def analysis_windows(spark, d):
    """E5"""
    s = X.derived(spark, d, "instructions").select("call_id", (F.col("anchor_s") - 1.5).alias("from_s"), (F.col("anchor_s") + 2.5).alias("to_s"))
    s = s.join(X.durations(spark, d), "call_id")
    return clicks.merged_windows(s, F.col("duration_s")).select("call_id", F.round("from_s", 6).alias("from_s"), F.round("to_s", 6).alias("to_s"))


@query(X.derived_sql("elements") + """, p as (select a.call_id, a.element_seq as left_seq, b.element_seq as right_seq, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))::bigint * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
  (a.x2 - a.x1)::bigint * (a.y2 - a.y1) as aa, (b.x2 - b.x1)::bigint * (b.y2 - b.y1) as ab, greatest(0, least(a.last_seen_s, b.last_seen_s) - greatest(a.first_seen_s, b.first_seen_s)) / (greatest(a.last_seen_s, b.last_seen_s) - least(a.first_seen_s, b.first_seen_s)) as t
  from elements a join elements b on a.call_id = b.call_id and a.element_seq < b.element_seq and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 and a.first_seen_s <= b.last_seen_s and b.first_seen_s <= a.last_seen_s)
  select call_id, left_seq, right_seq, round(inter / (aa + ab - inter)::double, 6) as iou, round(coalesce(case when isfinite(t) then t end, 0), 6) as time_iou from p""")
def box_overlaps(spark, d):
    """Overlap in space and time of all elements of one call that share area and are seen at one time.

    Boxes meet in the grid cells and time buckets that they touch; a pair is told only in the one with the corner where
    its overlap begins.
    """
    b = lambda p: F.struct(*[F.col(f"{p}.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])
    e = X.derived(spark, d, "elements")
    for name, low, high, wide in (("cx", "x1", "x2", 128), ("cy", "y1", "y2", 128), ("ct", "first_seen_s", "last_seen_s", 10)):
        e = e.withColumn(name, F.explode(F.expr(f"sequence(cast(floor({low} / {wide}) as int), cast(floor({high} / {wide}) as int))")))
    begins = " and ".join(f"a.{c} = cast(floor(greatest(a.{low}, b.{low}) / {wide}) as int)" for c, low, wide in (("cx", "x1", 128), ("cy", "y1", 128), ("ct", "first_seen_s", 10)))
    overlap = "a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 and a.first_seen_s <= b.last_seen_s and b.first_seen_s <= a.last_seen_s"
    p = e.alias("a").join(e.alias("b"), F.expr(f"a.call_id = b.call_id and a.cx = b.cx and a.cy = b.cy and a.ct = b.ct and a.element_seq < b.element_seq and {overlap} and {begins}"))
    return p.select("a.call_id", F.col("a.element_seq").alias("left_seq"), F.col("b.element_seq").alias("right_seq"), F.round(G.iou(b("a"), b("b")), 6).alias("iou"), F.round(G.interval_iou(F.col("a.first_seen_s"), F.col("a.last_seen_s"), F.col("b.first_seen_s"), F.col("b.last_seen_s")), 6).alias("time_iou"))


@query(X.derived_sql("clicks") + """ select call_id, vis_seq, greatest(0, least(x - 320, 1280))::int as x1, greatest(0, least(y - 200, 680))::int as y1, greatest(0, least(x - 320, 1280))::int + 640 as x2, greatest(0, least(y - 200, 680))::int + 400 as y2 from clicks where x is not null""")
def crop_windows(spark, d):
    """B24"""
    w = G.crop_window(F.struct("x", "y"), F.lit(X.WIDTH), F.lit(X.HEIGHT))
    return X.derived(spark, d, "clicks").where("x is not null").select("call_id", "vis_seq", w.alias("w")).select("call_id", "vis_seq", "w.*")


@query()
def registry_elements(spark, d):
    """H6: detections of a call, three noisy looks at each element, joined into stable elements"""
    e = X.derived(spark, d, "elements")
    looks = e.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    det = looks.select("call_id", (F.col("first_seen_s") + F.col("k")).alias("time_s"), (F.col("element_seq") * 3 + F.col("k")).alias("det_seq"), *[(F.col(c) + F.col("k")).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "text", "text_confidence", "interactive_confidence", "class")
    return targets.stable_elements(det)


@query(X.derived_sql("clicks", "elements") + f", early as ({ELEMENT_AT.format(tol='0.6e0', shift='(-0.3e0)')}), late as ({ELEMENT_AT.format(tol='1.0e0', shift='0.0e0')})," + """
 c as (select c.call_id, c.vis_seq, c.time_s, c.x, coalesce(early.element_seq, late.element_seq) as target_seq, max(c.time_s) over (partition by c.call_id) + 1 as d from clicks c left join early using (call_id, vis_seq) left join late using (call_id, vis_seq)),
 a as (select *, 'ui_frame' as service, time_s - 0.3 as f, time_s - 0.3 as t from c union all select *, 'ui_frame', time_s + 0.4, time_s + 0.4 from c union all select *, 'pointing', time_s - 0.5, time_s + 0.5 from c where x is null
  union all select *, 'tracking', time_s - 1, time_s + 1 from c where target_seq is not null union all select *, 'narrative', time_s - 1.2, time_s + 1.1 from c)
 select call_id, vis_seq, service, round(least(greatest(0, f), least(d, t)), 6) as from_s, round(least(d, t), 6) as to_s from a""")
def model_requests(spark, d):
    """H7, C20, C21"""
    e = targets.targets_at_points(events(spark, d), X.derived(spark, d, "elements"))
    calls = e.groupBy("call_id").agg((F.max("time_s") + 1).alias("duration_s"))
    return targets.requests(e, calls).select("call_id", "vis_seq", "service", F.round("from_s", 6).alias("from_s"), F.round("to_s", 6).alias("to_s"))


@query(X.derived_sql("clicks") + """ select call_id, vis_seq, coalesce(x, vis_seq % 500)::int as x, case when x is null then vis_seq % 300 else y end::int as y, case when x is null then 'vlm_pointing' else point_source end as point_source,
 case when point_source is null then 1 else 2 end + case when x is null then 1 else 0 end + case when vis_seq % 3 = 0 then 1 else 0 end as n_evidence from clicks""")
def pointing_and_tracking(spark, d):
    """Pointing answers for events without a point, tracker samples for the rest"""
    e = events(spark, d)
    points = e.select("call_id", "vis_seq", "time_s", (F.col("vis_seq") % 500).cast("int").alias("x"), (F.col("vis_seq") % 300).cast("int").alias("y"), F.lit(0.6).alias("confidence"))
    samples = e.where("vis_seq % 3 = 0").select("call_id", "vis_seq", "time_s", "x", "y", F.col("detector_confidence").alias("confidence"))
    out = targets.tracker_evidence(targets.pointing_fallback(e, points), samples)
    return out.select("call_id", "vis_seq", "x", "y", "point_source", F.size("evidence").alias("n_evidence"))


@query(X.derived_sql("clicks", "elements") + f", early as ({ELEMENT_AT.format(tol='0.6e0', shift='(-0.3e0)')}), late as ({ELEMENT_AT.format(tol='1.0e0', shift='0.0e0')})" + """,
 t as (select c.call_id, coalesce(early.element_seq, late.element_seq) as element_seq, min(c.time_s - 3.0e0) as low, max(c.time_s + c.vis_seq % 7) as high from clicks c left join early using (call_id, vis_seq) left join late using (call_id, vis_seq) where c.vis_seq % 2 = 0 group by 1, 2)
 select call_id, element_seq, round(least(first_seen_s, coalesce(low, first_seen_s)), 6) as first_seen_s, round(greatest(last_seen_s, coalesce(high, last_seen_s)), 6) as last_seen_s from elements left join t using (call_id, element_seq)""")
def elements_seen_longer(spark, d):
    """Tracker samples before and after every second event widen the time in which its target was seen"""
    elements = X.derived(spark, d, "elements")
    e = targets.targets_at_points(events(spark, d), elements)
    at = F.explode(F.array(F.col("time_s") - 3.0, F.col("time_s"), F.col("time_s") + F.col("vis_seq") % 7))
    samples = events(spark, d).where("vis_seq % 2 = 0").select("call_id", "vis_seq", at.alias("time_s"))
    return targets.seen_longer(elements, e, samples).select("call_id", "element_seq", *[F.round(c, 6).alias(c) for c in ("first_seen_s", "last_seen_s")])
