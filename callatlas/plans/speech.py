"""Queries over speech and articles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import articles as A
from ..operators import describe as D
from ..operators import evaluation as E
from ..operators.quantiles import exact_quantiles
from ..operators import fusion, targets
from ..operators import transcripts as S
from ..sources import fixtures as X
from ..sources import packages
from . import core
from .held import held, shared_root

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def segs(spark, d):
    return S.segments(X.transcripts(spark, d))


@query(f"with {X.segments_sql()}" + """ select call_id, seg_idx, word_idx, word, round(start_s + step * word_idx, 6) as start_s, round(start_s + step * (word_idx + 1), 6) as end_s,
 case when (turn + word_idx) % 5 = 0 then 0.27e0 else 0.9e0 end as score, speaker from said""")
def transcript_words(spark, d):
    """A1, B1: words of the scripted calls with their times filled in"""
    return S.words_of(segs(spark, d)).select("call_id", "seg_idx", "word_idx", "word", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.round("score", 6).alias("score"), "speaker")


def _matches(text: str, pattern: str) -> str:
    """A pattern of the library over text for the oracle, whose \\w knows ASCII only."""
    return f"regexp_matches({text}, '" + pattern.replace("\\w", "[\\pL\\pN_]") + "', 'i')"


QUOTED_SQL = T.QUOTED_TARGET.replace("'", "''")
ACTING = "|".join(f"(?:{p})" for _, p in T.ACTIONS)
#: Words one after the other: part and held are the clause that the word leaves behind, own the one that it is in, null for none.
CLAUSES = f"""with recursive {X.segments_sql()},
 tok as (select call_id, seg_idx, turn, word_idx, trim(word) as word, start_s + step * word_idx as s, start_s + step * (word_idx + 1) as e, regexp_matches(trim(word), '[,;.]$') as stops, lower(regexp_replace(trim(word), '[^\\pL\\pN_]+$', '')) in {S.MARKERS} as marks from said),
 walk as (select call_id, seg_idx, -1::bigint as word_idx, 0 as part, '' as held, null::int as own from seg
  union all select call_id, seg_idx, word_idx, case when ends then part + 1 else part end, case when ends then '' else heard end, case when not marks then part end
  from (select *, {_matches("heard", ACTING)} and (marks or stops) as ends from (select t.*, w.part, case when marks then w.held else trim(w.held || ' ' || t.word) end as heard from walk w join tok t on t.call_id = w.call_id and t.seg_idx = w.seg_idx and t.word_idx = w.word_idx + 1))),
 clause as (select call_id, seg_idx, own as ordinal, string_agg(word, ' ' order by word_idx) as text, coalesce(arg_min(e, word_idx) filter (where {_matches("word", T.DEICTIC)}), max(e)) as anchor_s,
   list_reduce(list_prepend(0.0::double, list(case when (turn + word_idx) % 5 = 0 then 0.27::double else 0.9::double end order by word_idx)), lambda x, y: x + y) / count(*) as mean
  from walk join tok using (call_id, seg_idx, word_idx) where own is not null group by call_id, seg_idx, own),
 asked as (select *, case {' '.join(f"when {_matches('text', p)} then '{name}'" for name, p in T.ACTIONS)} else 'unknown' end as spoken_action, case when regexp_extract(text, '{QUOTED_SQL}', 1) <> '' then trim(regexp_extract(text, '{QUOTED_SQL}', 1)) when trim(regexp_extract(text, '{T.PREPOSITION_TARGET}', 1)) not in ('', {str(T.POLITE)[1:-1]}) then trim(regexp_extract(text, '{T.PREPOSITION_TARGET}', 1)) end as target from clause)"""


@query(CLAUSES + f""" select call_id, printf('audio_%04d', row_number() over (partition by call_id order by seg_idx, ordinal) - 1) as ref_id, seg_idx::int as seg_idx, ordinal, text, round(anchor_s, 6) as anchor_s, spoken_action,
 case when {_matches("target", T.DEICTIC)} and target not like '% %' then null else target end as explicit_target, {core.rounded("mean")} as asr_confidence, 1.0::double as alignment_confidence from asked where spoken_action <> 'unknown'""")
def transcript_instructions(spark, d):
    """E10, D1, E1"""
    return S.instructions(segs(spark, d)).select("call_id", "ref_id", "seg_idx", "ordinal", "text", F.round("anchor_s", 6).alias("anchor_s"), "spoken_action", "explicit_target", "asr_confidence", "alignment_confidence")


@query(f"""with {X.WORDS_SQL},
 b as (select *, coalesce(speaker <> lag(speaker) over w, false) or coalesce(lag(regexp_matches(word, '[.!?…]\\n?$') and not regexp_matches(word, '^[0-9]+\\.\\n?$')) over w, false) as brk from words window w as (partition by call_id, seg_idx order by word_idx)),
 r as (select *, sum(case when brk then 1 else 0 end) over (partition by call_id, seg_idx order by word_idx rows unbounded preceding) as run from b),
 p as (select *, (row_number() over (partition by call_id, seg_idx, run order by word_idx) - 1) // 40 as part from r)
 select call_id, seg_idx, (row_number() over (partition by call_id, seg_idx order by run, part) - 1)::int as piece, round(min(start_s), 6) as start_s, round(max(end_s), 6) as end_s, string_agg(word, ' ' order by word_idx) as raw, any_value(speaker) as speaker from p group by call_id, seg_idx, run, part""")
def sentence_pieces(spark, d):
    """E3, D2"""
    return S.sentence_pieces(X.words(spark, d)).select("call_id", "seg_idx", "piece", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "raw", "speaker")


SENTENCES = f"""with recursive {X.segments_sql()},
 brk as (select *, coalesce(lag(regexp_matches(word, '[.!?…]$') and not regexp_matches(word, '^[0-9]+\\.$')) over w, false) as brk from said window w as (partition by call_id, seg_idx order by word_idx)),
 runs as (select *, sum(case when brk then 1 else 0 end) over (partition by call_id, seg_idx order by word_idx rows unbounded preceding) as run from brk),
 parts as (select *, (row_number() over (partition by call_id, seg_idx, run order by word_idx) - 1) // 40 as part from runs),
 raw as (select call_id, seg_idx, run, part, min(start_s + step * word_idx) as s, max(start_s + step * (word_idx + 1)) as e, string_agg(word, ' ' order by word_idx) as t, any_value(speaker) as speaker from parts group by call_id, seg_idx, run, part),
 bare as (select * replace (trim(regexp_replace(t, '^(?:(?:äh|ähm|ehm|uh|uhm)\\b[,\\s]*|(?:also|so|okay|ok|ja|nun|gut|und|um|well|right|alright|now|and)\\s*,\\s*)+', '', 'i')) as t) from raw),
 calm as (select * replace (regexp_replace(trim(regexp_replace(t, '(^|[^\\pL\\pN_])(?:(?:äh|ähm|ehm|uh|uhm)\\b,?\\s*)+', '\\1', 'gi')), '\\s+([,.!?])', '\\1', 'g') as t) from bare),
 once as (select * replace (list_reduce(string_split(t, ' '), lambda x, y: case when regexp_extract(y, '^[\\pL\\pN_]+') <> '' and lower(regexp_extract(y, '^[\\pL\\pN_]+')) = lower(regexp_extract(x, '[\\pL\\pN_]+$')) then x || regexp_replace(y, '^[\\pL\\pN_]+', '') else x || ' ' || y end) as t) from calm),
 rows as (select *, row_number() over (partition by call_id order by seg_idx, run, part) as k from (select * replace (upper(t[1]) || t[2:] as t) from once) where length(t) >= 3),
 walk as (select call_id, k, 1 as sent_no, s, e, t, speaker from rows where k = 1
  union all select call_id, k, case when joins then sent_no else sent_no + 1 end, case when joins then s0 else s end, e, case when joins then t0 || ' ' || lower(t[1]) || t[2:] else t end, speaker
  from (select n.*, w.sent_no, w.s as s0, w.t as t0, w.speaker = n.speaker and w.t[-1] not in ('.', '!', '?', '…') and n.s - w.e < 1 and least(a, b) <= 6 and a + b <= 45 as joins
   from walk w join rows n on w.call_id = n.call_id and n.k = w.k + 1, lateral (select len(string_split(w.t, ' ')) as a, len(string_split(n.t, ' ')) as b))),
 sentences as (select call_id, sent_no::int as sent_no, min(s) as start_s, max(e) as end_s, arg_max(t, k) as text, any_value(speaker) as speaker from walk group by call_id, sent_no)"""


@query(SENTENCES + " select call_id, sent_no, round(start_s, 6) as start_s, round(end_s, 6) as end_s, text, speaker from sentences")
def call_sentences(spark, d):
    """B2, E3, E4"""
    return S.sentences(S.words_of(segs(spark, d))).select("call_id", "sent_no", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text", "speaker")


@query("select conv_id as call_id, turn as seg_idx, " + "case when de + en < 3 then null when de >= 2 * en then 'de' when en >= 2 * de then 'en' end as language from (select conv_id, turn, " + ", ".join(f"len(list_filter(regexp_split_to_array(lower(text), '[ ,.!?;:\\n]'), lambda w: w in {words}))" + f" as {n}" for n, words in (("de", T.GERMAN_WORDS), ("en", T.ENGLISH_WORDS))) + " from conversations)")
def turn_languages(spark, d):
    """B6"""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_idx"), T.guess_language(F.col("text")).alias("language"))


@query(f"with {X.WORDS_SQL} select call_id, count(distinct seg_idx) as n_segments, count(*) as n_words, count(distinct speaker) as n_speakers from words group by call_id")
def call_counts(spark, d):
    """D7"""
    return X.words(spark, d).groupBy("call_id").agg(F.countDistinct("seg_idx").alias("n_segments"), F.count("*").alias("n_words"), F.countDistinct("speaker").alias("n_speakers"))


def _stamped(ms: str, short: bool = False) -> str:
    return f"printf('%02d:%02d', floor({ms} / 60000)::bigint, floor({ms} / 1000)::bigint % 60)" + ("" if short else f" || printf(',%03d', {ms} % 1000)")


STAMP = "printf('%02d:%02d:%02d,%03d', ({t}) // 3600, ({t}) // 60 % 60, ({t}) % 60, {ms})"


@query(f"with {X.segments_sql()}" + f", b as (select *, speaker || ': ' || text as line, (row_number() over (partition by call_id order by seg_idx)) || chr(10) || {STAMP.format(t='turn::bigint * 10', ms=0)} || ' --> ' || {STAMP.format(t='turn::bigint * 10 + 9', ms=500)} || chr(10) || speaker || ': ' || text || chr(10) as block from seg) select call_id, string_agg(block, chr(10) order by seg_idx) as srt, string_agg(line, chr(10) order by seg_idx) as plain from b group by 1")
def subtitles(spark, d):
    """A8, B19"""
    return S.srt(segs(spark, d))


SPANS = f"with {X.WORDS_SQL}, seg as (select call_id, seg_idx, min(start_s) as start_s, max(end_s) as end_s, any_value(speaker) as speaker from words group by call_id, seg_idx)"


def _spans(spark, d):
    return X.words(spark, d).groupBy("call_id", "seg_idx").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("speaker").alias("speaker"))


@query(SPANS + " select w.call_id, w.seg_idx * 1000 + w.word_idx as word_idx, min(s.seg_idx) as seg_idx from words w join seg s on w.call_id = s.call_id and w.start_s >= s.start_s - 0.05e0 and w.start_s < s.end_s + 0.05e0 group by 1, 2")
def word_owners(spark, d):
    """C13"""
    w = X.words(spark, d).withColumn("word_idx", F.col("seg_idx") * 1000 + F.col("word_idx"))
    return S.words_to_segments(w, _spans(spark, d))


@query(SPANS + """, p as (select call_id, seg_idx as piece, start_s + 1 as ps, end_s + 40 as pe from seg), o as (select p.call_id, piece, seg.seg_idx, seg.speaker, least(pe, end_s) - greatest(ps, start_s) as o from p join seg using (call_id))
 select call_id, piece, speaker from (select *, row_number() over (partition by call_id, piece order by o desc, seg_idx) as k from o) where k = 1""")
def piece_speakers(spark, d):
    """C18"""
    s = _spans(spark, d)
    p = s.select("call_id", F.col("seg_idx").alias("piece"), (F.col("start_s") + 1).alias("start_s"), (F.col("end_s") + 40).alias("end_s"))
    return S.overlap_speakers(p, s)


@query(SPANS + """, s as (select *, min(seg_idx) over (partition by call_id, speaker) as f, row_number() over (partition by call_id, speaker order by abs(end_s - start_s - 6), seg_idx) as k from seg where speaker is not null and end_s - start_s >= 3),
 t as (select *, row_number() over (partition by call_id order by f) as place from s where k = 1) select call_id, replace(speaker, 'SPEAKER_', '') as name, round(start_s, 6) as start_s, round(least(end_s, start_s + 10), 6) as end_s from t where place <= 4""")
def speaker_clips(spark, d):
    """E11"""
    return S.speaker_clips(_spans(spark, d)).select("call_id", "name", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(core.recursive(SPANS + """, sil as (select call_id, end_s * 10 as s, end_s * 10 + 2 as e from seg), dur as (select call_id, max(end_s) * 10 as d from seg group by 1),
 steps as (select call_id, d, 0 as part, 0.0::double as from_s from dur
  union all select call_id, d, part + 1, coalesce(mid, from_s + 180) from (
   select c.call_id, c.d, c.part, c.from_s, (s.s + s.e) / 2 as mid, row_number() over (partition by c.call_id order by s.e - s.s desc nulls last, s.s) as k
   from steps c left join sil s on s.call_id = c.call_id and (s.s + s.e) / 2 > c.from_s + 0.75 * 180 and (s.s + s.e) / 2 < c.from_s + 180 where c.d - c.from_s > 180) where k = 1)
 select call_id, part, from_s, coalesce(lead(from_s) over (partition by call_id order by part), d) as to_s from steps"""))
def call_parts(spark, d):
    """Calls cut at pauses between their turns"""
    s = _spans(spark, d)
    calls = s.groupBy("call_id").agg((F.max("end_s") * 10).alias("duration_s"))
    return S.parts(calls, s.select("call_id", (F.col("end_s") * 10).alias("start_s"), (F.col("end_s") * 10 + 2).alias("end_s")), 300.0)


@query(f"with {X.segments_sql()}" + """ select call_id, row_number() over (partition by call_id order by seg_idx) - 1 as seg_idx, start_s + (seg_idx // 3) * 30.0 as start_s, end_s + (seg_idx // 3) * 30.0 as end_s, trim(text) as text, len(string_split(text, ' ')) as n_words from seg""")
def parts_onto_calls(spark, d):
    """E13"""
    s = segs(spark, d).withColumns({"part": (F.col("seg_idx") / 3).cast("int")})
    cut = s.select("call_id", "part").distinct().withColumn("from_s", F.col("part") * 30.0)
    return S.onto_call(s, cut).select("call_id", "seg_idx", "start_s", "end_s", "text", F.size("words").alias("n_words"))


COUNTED = ", ".join(f"len(list_filter(regexp_split_to_array(lower(text), '[ ,.!?;:\\n]'), lambda w: w in {words})) as {n}" for n, words in (("de", T.GERMAN_WORDS), ("en", T.ENGLISH_WORDS)))


@query(f"with {X.segments_sql()}" + f""", t as (select call_id, string_agg(text, ' ' order by start_s) as text from seg group by 1), l as (select call_id, {COUNTED} from t),
 w as (select call_id, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) * 0.7e0 as at_s from t where call_id % 3 = 1),
 own as (select w.call_id, at_s, min(seg_idx) as seg_idx from w join seg on w.call_id = seg.call_id and word <> '' and at_s >= start_s - 0.05e0 and at_s < end_s + 0.05e0 group by 1, 2),
 k as (select call_id, seg_idx, count(*) as n from own group by 1, 2),
 n as (select call_id, count(*) as segs, sum(coalesce(k.n, len(list_filter(string_split(text, ' '), lambda x: x <> '')))) as words, count(speaker) as labelled from seg left join k using (call_id, seg_idx) group by 1)
 select call_id, case when call_id % 3 <> 0 then 'de' when de + en < 3 then null when de >= 2 * en then 'de' when en >= 2 * de then 'en' end as language, case when call_id % 3 = 2 then 1 else segs end as n_segments, words as n_words, case when call_id % 3 = 0 then labelled else 0 end as n_labelled
 from n join l using (call_id)""")
def cloud_answers(spark, d):
    """Answers of three shapes made of the scripted calls, read back as transcripts"""
    t = X.segments(spark, d).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "speaker"))).alias("segments"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("word"), (i * 0.7).alias("start"), (i * 0.7 + 0.5).alias("end")))
    none = F.lit(None)
    shape = F.col("call_id") % 3
    body = F.to_json(F.struct(F.when(shape != 0, "german").alias("language"), text.alias("text"), F.when(shape == 1, words).alias("words"), F.when(shape != 2, F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.when(shape == 0, F.regexp_replace(s["speaker"], "SPEAKER_", "")).otherwise(none).alias("speaker")))).alias("segments")))
    out = S.from_answers(t.select("call_id", body.alias("body")))
    return out.select("call_id", "language", F.size("segments").alias("n_segments"), F.expr("aggregate(segments, 0, (a, s) -> a + size(s.words))").alias("n_words"), F.expr("size(filter(segments, s -> s.speaker is not null))").alias("n_labelled"))


def draft(spark, d):
    s = segs(spark, d)
    refs = held(S.instructions(s))
    return A.draft(held(S.sentences(S.words_of(s))), refs, X.transcripts(spark, d).select("call_id", "language")), refs


@query()
def article_drafts(spark, d):
    """C9, B14-B17, D8, E8, G3"""
    return draft(spark, d)[0][0]


@query()
def article_steps(spark, d):
    """E8, B16, B17"""
    return draft(spark, d)[0][1].drop("refs")


@query()
def redacted_articles(spark, d):
    """B12, B13"""
    (a, s), _ = draft(spark, d)
    return A.redacted(a, s)[0]


@query()
def article_pages(spark, d):
    """Redacted articles as Markdown packages"""
    (a, s), _ = draft(spark, d)
    a, s = A.redacted(a, s)
    return A.package(A.markdown(a, s, "2024-01-01")).select("call_id", "path", F.decode("content", "UTF-8").alias("content"))


@query(f"with {X.segments_sql()}" + """, page as (select call_id, string_agg(text, chr(10) order by turn) as text from seg group by call_id)
 select call_id, 'call-' || call_id || '/article.md' as path, case when call_id % 3 = 0 then 'r2' else 'r1' end as run, strlen(body)::int as bytes, md5(body) as digest from (select call_id, text || case when call_id % 3 = 0 then ' (new)' else '' end as body from page)
 union all select call_id, 'call-' || call_id || printf('/images/step-%02d.jpg', turn + 1), 'r1', strlen(text)::int, md5(text) from seg where turn % 2 = 0 and call_id % 3 <> 0""")
def published_packages(spark, d):
    """A run of all calls with images, a run that replaces every third, and a run that ends before its commit"""
    t = X.segments(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), "\n")
    pages = t.groupBy("call_id").agg(text.alias("markdown")).withColumn("slug", F.concat(F.lit("call-"), F.col("call_id").cast("string")))
    images = t.select("call_id", (F.col("seg_idx") + 1).alias("number"), F.when(F.col("seg_idx") % 2 == 0, F.encode("text", "UTF-8")).alias("image"))
    store = f"{shared_root(spark).rstrip('/')}/packages-{uuid.uuid4().hex}"
    packages.publish(A.package(pages, images), store, "r1")
    packages.publish(A.package(pages.where("call_id % 3 = 0").withColumn("markdown", F.concat("markdown", F.lit(" (new)")))), store, "r2")
    packages.prepare(A.package(pages.withColumn("markdown", F.lit("unfinished")), images), store, "r3")
    return packages.files(spark, store).select("call_id", "path", "run", F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"))


def _worded(c: str, words: dict) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in words.items() if k) + f" else '{words[None]}' end"


def _described(de: bool) -> str:
    """B18 as SQL over told, the events with their targets and references."""
    pick = lambda german, english: f"'{german if de else english}'"
    third = lambda v, low, mid, high: f"case when {v} < 0.33e0 then {low} when {v} > 0.66e0 then {high} else {mid} end"
    verb, kind = (_worded(c, w["de" if de else "en"]) for c, w in (("action", D.VERBS), ("class", D.CLASSES)))
    across = third("(x1 + x2) / 2e0 / 1920", pick("linken", "left"), pick("mittleren", "center"), pick("rechten", "right"))
    down = third("(y1 + y2) / 2e0 / 1080", pick("oberen", "upper"), pick("mittleren", "middle"), pick("unteren", "lower"))
    region = f"' im ' || {across} || ' ' || {down} || ' Bereich des Fensters'" if de else f"' in the ' || {down} || ' ' || {across} || ' area of the window'"
    actor = f"case when point_source in ('cursor_tracker', 'telemetry') then {pick('Der sichtbare Mauszeiger', 'The visible mouse cursor')} else {pick('Die Aktion', 'The action')} end"
    sure = "round(overall_confidence::decimal(6, 3), 2)::decimal(6, 2)::varchar"
    return f"""{actor} || ' ' || {verb} || case when grounding_status = 'unobservable' then {pick('; die genaue Position ist im Video nicht beobachtbar.', '; the exact position is not observable in the video.')}
 else {pick(' bei x=', ' at x=')} || x || ', y=' || y || case when target_seq is null then '' else {pick(' auf ', ' on ')} || case when target_text is null then {kind} || ' ' || printf('ui_%03d', target_seq) else {pick('', 'the ')} || {kind} || {pick(' „', ' "')} || target_text || {pick('“', '"')} end || {region} end
 || case grounding_status when 'tracked' then {pick(' (per Tracking verfolgt)', ' (position tracked)')} when 'inferred' then {pick(' (Position geschätzt, nicht direkt beobachtet)', ' (position inferred, not directly observed)')} else '' end || '.'
 || case when target_seq is null then '' else {pick(' Das Element belegt ungefähr [', ' The element occupies approximately [')} || x1 || ', ' || y1 || ']–[' || x2 || ', ' || y2 || '] px.' end
 || case when state_change_confidence >= 0.5 or (point_source = 'frame_state_change' and detector_confidence >= 0.5) then {pick(' Unmittelbar anschließend ändert sich die Ansicht.', ' The view changes immediately afterwards.')} else '' end
 || case when ref_seq is null then '' else {pick(' Die Zuordnung zur Audioanweisung wird mit ', ' The association with the spoken instruction is rated at ')} || {f"replace({sure}, '.', ',')" if de else sure} || {pick(' Gesamtvertrauen bewertet.', ' overall confidence.')} end end"""


TOLD = core.recursive(core.GRAPH) + f""", told as (select g.*, {core.rounded("g.time_s")} as peak_s, e.x1, e.y1, e.x2, e.y2, e.text as target_text, e.class, r.text as said, r.speaker, {core.rounded("r.start_s")} as rs, {core.rounded("r.end_s")} as re
  from g left join elements e on g.call_id = e.call_id and g.target_seq = e.element_seq left join refs r on g.call_id = r.call_id and g.ref_seq = r.ref_seq)"""


def graph(spark, d):
    e = targets.targets_at_points(core.events(spark, d), X.derived(spark, d, "elements"))
    b = held(core.bound(spark, d))
    return fusion.grounded_events(e, b, core.references(spark, d), X.derived(spark, d, "elements")), fusion.unbound(core.references(spark, d), b)


@query(TOLD + f" select call_id, vis_seq, printf('event_%04d', n) as event_id, {_described(True)} as description_de, {_described(False)} as description_en from told")
def event_descriptions(spark, d):
    """B18"""
    return graph(spark, d)[0].select("call_id", "vis_seq", "event_id", D.description("de").alias("description_de"), D.description("en").alias("description_en"))


MS = "round({} * 1000)::bigint"


@query(TOLD + f""", lines as (select call_id, peak_s as time_s, 0 as late, vis_seq as seq, 1 as k, {_stamped(MS.format("peak_s"))} || ': ' || {_described(False)} as line from told
  union all select call_id, rs, 0, vis_seq, 0, {_stamped(MS.format("rs"))} || '–' || {_stamped(MS.format("re"))} || ': ' || coalesce(speaker, 'Speaker') || ' says: "' || said || '"' from told where ref_seq is not null
  union all select call_id, rs, 1, ref_seq, 0, {_stamped(MS.format("rs"))} || '–' || {_stamped(MS.format("re"))} || ': ' || coalesce(speaker, 'Speaker') || ' says: "' || text || '" (No associated visual event observed.)'
   from (select *, {core.rounded("start_s")} as rs, {core.rounded("end_s")} as re from refs anti join bound using (call_id, ref_seq)))
 select call_id, string_agg(line, chr(10) order by time_s, late, seq, k) as timeline from lines group by 1""")
def timelines(spark, d):
    """G1, F2, A9"""
    return D.timeline_text(D.timeline(*graph(spark, d), "en"))


@query()
def graph_documents(spark, d):
    """A6"""
    return D.graph_documents(*graph(spark, d))


@query(TOLD + f""", a as (select *, row_number() over (partition by call_id order by ref_seq is null, overall_confidence desc, peak_s, vis_seq) as k from told where grounding_status in ('observed', 'tracked'))
 select call_id, vis_seq, peak_s, '[' || {_stamped(MS.format("peak_s"), True)} || '] ' || case when target_text is null then case when call_id % 2 = 0 then 'Klick bei (' else 'click at (' end || x || ', ' || y || ')' when call_id % 2 = 0 then 'Klick auf „' || target_text || '“' else 'click on "' || target_text || '"' end
  || case when said is null then '' when call_id % 2 = 0 then ' – gesagt: „' || said || '“' else ' – said: "' || said || '"' end as line from a where k <= 40""")
def observed_actions(spark, d):
    """F1, B25"""
    g, _ = graph(spark, d)
    p = F.col("spatial.point_xy_px")
    e = g.select("call_id", "vis_seq", F.col("temporal.peak_s").alias("peak_s"), F.when(p.isNotNull(), F.struct(p[0].alias("x"), p[1].alias("y"))).alias("point"), "grounding_status", "overall_confidence", F.col("target.text").alias("target_text"), F.transform("audio_references", lambda r: r["transcript"]).alias("said"))
    return A.observed_actions(e, F.when(F.col("call_id") % 2 == 0, "de").otherwise("en"))


@query(SENTENCES + f""" select call_id, string_agg('[' || sent_no || '] (' || {_stamped("round(start_s * 1000)::bigint", True)} || ') ' || coalesce(speaker || ': ', '') || text, chr(10) order by sent_no) as transcript from sentences group by call_id""")
def article_prompts(spark, d):
    """D10"""
    return A.prompts(S.sentences(S.words_of(segs(spark, d))))


@query()
def screenshot_times(spark, d):
    """C10, F5, B23"""
    (a, s), refs = draft(spark, d)
    clicks = refs.where("ref_seq % 2 = 0").select("call_id", F.col("ref_seq").cast("long").alias("vis_seq"), (F.col("anchor_s") + 0.1).alias("peak_s"), F.struct(F.lit(100).alias("x"), F.lit(200).alias("y")).alias("point"), F.lit("observed").alias("grounding_status"), F.lit(0.8).alias("overall_confidence"), F.lit(0.5).alias("change"), "ref_seq")
    shots = A.screenshots(s, A.reliable_clicks(s, clicks, refs))
    return A.private(shots.withColumn("screenshot_s", F.round("screenshot_s", 6)), a.withColumn("private", F.col("call_id") % 7 == 0))


def answers(spark, d):
    """Model answers made of the drafts: every second step, sentence numbers as strings, some answers not JSON."""
    (a, s), _ = draft(spark, d)
    a, s, sents = held(a), held(s), held(S.sentences(S.words_of(segs(spark, d))))
    steps = s.join(sents.select("call_id", F.col("start_s").alias("time_s"), "sent_no"), ["call_id", "time_s"], "left").where("number % 2 = 1")
    g = steps.groupBy("call_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "title", "instruction", "sent_no"))), lambda x: F.struct(x["title"].alias("title"), x["instruction"].alias("instruction"), F.lit("none").alias("details"), F.array(F.concat(F.lit("["), x["sent_no"].cast("string"), F.lit("]"))).alias("sentences"))).alias("steps"))
    j = a.join(g, "call_id", "left")
    raw = F.when(F.col("call_id") % 5 == 4, F.lit("no answer")).otherwise(F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.lit("A title").alias("title"), F.lit("n/a").alias("cause"), "steps", F.lit("true").alias("resolved"), F.array(F.lit("print"), F.lit("none")).alias("keywords")))))
    return held(j.select("call_id", raw.alias("raw"))), sents, a, s


@query()
def written_articles(spark, d):
    """J3, J4"""
    raw, sents, a, _ = answers(spark, d)
    w, _ = A.parsed_answers(raw, sents)
    return A.chosen(a, w).select("call_id", "title", "problem", "cause", "keywords", "resolved", "method")


@query()
def restored_steps(spark, d):
    """J3, E9, F6, C11, C12"""
    raw, sents, _, s = answers(spark, d)
    w, ws = map(held, A.parsed_answers(raw, sents))
    missing = A.missing_steps(s.withColumn("point", F.array(F.lit(1), F.lit(2))), ws, w)
    return A.restored(ws, missing).select("call_id", "number", "instruction", "actor", "was_restored", F.round("time_s", 6).alias("time_s"))


def _finished(spark, d):
    """Articles whose drafts have a step a click and whose model wrote every third of them, some in the other language."""
    c = X.derived(spark, d, "clicks").withColumn("end_s", F.col("time_s") + 1.0)
    number = F.expr("row_number() over (partition by call_id order by time_s, vis_seq)")
    step = [F.concat(F.lit("S"), (F.col("vis_seq") % 5).cast("string")).alias("section"), F.lit("t").alias("title"), F.col("vis_seq").cast("string").alias("instruction"), F.lit(None).cast("string").alias("details"), F.when(F.col("vis_seq") % 2 == 1, "support").otherwise("customer").alias("actor"), "time_s", "end_s"]
    drafts = c.select("call_id", number.alias("number"), F.array(F.lit(1), F.lit(2)).alias("point"), *step)
    wrote = c.where("vis_seq % 3 = 1").select("call_id", number.alias("number"), *step)
    calls = c.select("call_id").distinct().withColumns({"resolved": F.col("call_id") % 6 != 5, "spoken": F.when(F.col("call_id") % 2 == 0, "de").otherwise("en")})
    calls = calls.withColumn("article", F.when(F.col("call_id") % 3 == 0, "en").otherwise(F.col("spoken")))
    said = X.derived(spark, d, "instructions").select("call_id", F.expr("row_number() over (partition by call_id order by start_s, ref_seq)").alias("sent_no"), "end_s")
    return A.finished(wrote, A.missing_steps(drafts, wrote, calls), calls, said)


FINISHED = X.derived_sql("clicks", "instructions") + """,
 drafts as (select call_id, vis_seq, row_number() over (partition by call_id order by time_s, vis_seq) as number, time_s, time_s + 1.0e0 as end_s from clicks),
 wrote as (select call_id, vis_seq, row_number() over (partition by call_id order by time_s, vis_seq) as number, time_s, end_s from drafts where vis_seq % 3 = 1),
 calls as (select distinct call_id, call_id % 6 <> 5 as resolved, call_id % 3 <> 0 or call_id % 2 = 1 as same from clicks),
 missing as (select d.*, same from drafts d join (select call_id, min(time_s) as first_s, any_value(same) as same from wrote join calls using (call_id) where resolved group by call_id) f using (call_id)
  where d.time_s >= first_s and not exists (select 1 from wrote w where w.call_id = d.call_id and w.time_s < d.end_s and d.time_s < w.end_s)),
 merged as (select call_id, vis_seq, time_s, end_s, number as place, false as was_restored from wrote union all select call_id, vis_seq, time_s, end_s, number + 1000000, true from missing where same),
 steps as (select *, row_number() over w as number, last_value(case when not was_restored then vis_seq end ignore nulls) over (partition by call_id order by time_s, place rows unbounded preceding) as own from merged window w as (partition by call_id order by time_s, place))"""


@query(FINISHED + " select call_id, number::int as number, vis_seq::varchar as instruction, 'S' || (own % 5) as section, case when own % 2 = 1 then 'support' else 'customer' end as actor, was_restored, round(time_s, 6) as time_s from steps")
def finished_steps(spark, d):
    """Missing clicks restored in the spoken language only"""
    return _finished(spark, d)[0].select("call_id", "number", "instruction", "section", "actor", "was_restored", F.round("time_s", 6).alias("time_s"))


@query(FINISHED + """, speech as (select call_id, arg_max(end_s, n) as speech_s from (select call_id, end_s, row_number() over (partition by call_id order by start_s, ref_seq) as n from instructions) group by call_id)
 select call_id, 'written' as note, count(w.vis_seq) as n, null::double as covered_s, null::double as speech_s from calls left join wrote w using (call_id) group by call_id
 union all select call_id, case when same then 'restored' else 'not_restored' end, count(*), null, null from missing group by call_id, same
 union all select call_id, 'short', null, round(covered_s, 6), round(speech_s, 6) from (select call_id, max(end_s) as covered_s from steps group by call_id) join speech using (call_id) where covered_s < 0.5e0 * speech_s""")
def article_notes(spark, d):
    """J4"""
    return _finished(spark, d)[1].withColumns({c: F.round(c, 6) for c in ("covered_s", "speech_s")})


def truth(spark, d):
    r = X.derived(spark, d, "instructions").where("ref_seq % 3 <> 0")
    return r.select("call_id", F.col("ref_seq").alias("gt_idx"), F.col("text").alias("action_utterance"), F.col("start_s").alias("utterance_start_s"), F.col("end_s").alias("utterance_end_s"), (F.col("anchor_s") + 0.2).alias("event_time_s"), F.lit("click").alias("event_type"), F.array((F.col("ref_seq") % 1900).cast("int"), (F.col("ref_seq") % 1000).cast("int")).alias("point"), F.array(F.lit(0), F.lit(0), F.lit(900), F.lit(900)).alias("target_bbox"), F.lit(None).cast("string").alias("ui_target_text"), (F.col("ref_seq") % 4 != 0).alias("observable"), "speaker")


ALIKE = ", ".join(str(i * len(X.PHRASES) + j) for i, a in enumerate(X.PHRASES) for j, b in enumerate(X.PHRASES) if targets.text_likeness(a, b) >= 0.6)


#: Every true event with what its candidate got right.
JUDGED = core.GRAPH + f""",
 truth as (select call_id, ref_seq as gt_idx, start_s as us, end_s as ue, anchor_s + 0.2e0 as event_time_s, ref_seq % 1900 as tx, ref_seq % 1000 as ty, ref_seq % 4 <> 0 as observable from instructions where ref_seq % 3 <> 0),
 e as (select g.call_id, g.vis_seq, {core.rounded("g.time_s")} as peak_s, g.action, g.grounding_status, g.x, g.y, {core.rounded("r.start_s")} as rs, {core.rounded("r.end_s")} as re, r.ref_seq from g join refs r using (call_id, ref_seq)),
 p as (select t.*, e.*exclude (call_id), row_number() over (partition by t.call_id, t.gt_idx order by abs(e.peak_s - t.event_time_s), e.vis_seq) as k from truth t join e on t.call_id = e.call_id
  and (least(e.re, t.ue) > greatest(e.rs, t.us) or (e.ref_seq % 12) * 12 + t.gt_idx % 12 in ({ALIKE}))),
 j as (select t.call_id, t.gt_idx, p.vis_seq is not null as phrase, coalesce(p.action = 'click', false) as action_ok, coalesce(abs(p.peak_s - t.event_time_s) <= 0.25, false) as time_ok,
  coalesce(p.vis_seq is not null and case when not t.observable then p.grounding_status <> 'observed' when p.x is not null then p.x between 0 and 900 and p.y between 0 and 900 else false end, false) as point_ok,
  sqrt((t.tx - p.x)^2 + (t.ty - p.y)^2) as off_px from truth t left join p on t.call_id = p.call_id and t.gt_idx = p.gt_idx and p.k = 1)"""


@query(core.recursive(JUDGED + """,
 f as (select call_id, avg(case when grounding_status <> 'inferred' then 1.0 else 0.0 end) as factual_precision from g group by 1),
 s as (select call_id, count(*) as n, avg((action_ok and time_ok and point_ok and phrase)::int) as right_share, avg(point_ok::int) as point_hit, avg(action_ok::int) as action_accuracy, avg(time_ok::int) as time_success, avg(phrase::int) as phrase_recall,
  coalesce(avg(off_px), 'nan'::double) as mean_px, coalesce(quantile_cont(off_px, 0.95), 'nan'::double) as p95_px from j group by 1)
 select call_id, n, round(right_share, 6) as all_right, round(point_hit, 6) as point_hit, round(action_accuracy, 6) as action_accuracy, round(time_success, 6) as time_success, round(phrase_recall, 6) as phrase_recall, round(mean_px, 6) as mean_px, round(p95_px, 6) as p95_px, round(factual_precision, 6) as factual_precision
 from s left join f using (call_id)"""))
def evaluation(spark, d):
    """C16, D3, D6"""
    g, _ = graph(spark, d)
    s = E.scores(E.judged(E.matched(truth(spark, d), bound(g))), "call_id").join(E.factual_precision(g, "call_id"), "call_id", "left")
    return s.select("call_id", "n", *[F.round(c, 6).alias(c) for c in ("all_right", "point_hit", "action_accuracy", "time_success", "phrase_recall", "mean_px", "p95_px", "factual_precision")])


def bound(g):
    """A row per event and bound reference of a graph."""
    return g.select("call_id", F.col("vis_seq").alias("event_seq"), F.col("temporal.peak_s").alias("peak_s"), "type", "grounding_status", F.col("spatial.point_xy_px")[0].alias("px"), F.col("spatial.point_xy_px")[1].alias("py"), F.col("target.text").alias("target_text"), F.explode("audio_references").alias("r")).select("*", F.col("r.start_s").alias("ref_start_s"), F.col("r.end_s").alias("ref_end_s"), F.col("r.transcript").alias("transcript"), F.col("r.speaker_id").alias("speaker"))


@query(core.recursive(JUDGED + " select count(*) as n, round(avg((action_ok and time_ok and point_ok and phrase)::int), 6) as all_right, round(avg(phrase::int), 6) as phrase_recall, round(avg(off_px), 6) as mean_px, round(quantile_cont(off_px, 0.5), 6) as p50_px, round(quantile_cont(off_px, 0.9), 6) as p90_px, round(quantile_cont(off_px, 0.95), 6) as p95_px from j"))
def corpus_evaluation(spark, d):
    """Over all calls"""
    s = E.corpus_scores(held(E.judged(E.matched(truth(spark, d), bound(graph(spark, d)[0]))).select("all_ok", "point_ok", "action_ok", "time_ok", "phrase", "off_px")))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("all_right", "phrase_recall", "mean_px", "p50_px", "p90_px", "p95_px")])


@query(X.derived_sql("instructions", "clicks") + """, t as (select call_id, ref_seq as gt_idx, anchor_s as time_s from instructions)
 select t.call_id, count(*) as n, round(avg(case when exists (select 1 from clicks c where c.call_id = t.call_id and abs(c.time_s - t.time_s) <= 0.25e0) then 1.0 else 0.0 end), 6) as recall from t group by 1""")
def click_time_success(spark, d):
    """C17"""
    t = X.derived(spark, d, "instructions").select("call_id", F.col("ref_seq").alias("gt_idx"), F.col("anchor_s").alias("time_s"))
    return E.click_time_success(X.derived(spark, d, "clicks"), t, 0.25).select("call_id", "n", F.round("recall", 6).alias("recall"))


@query(X.derived_sql("instructions", "clicks") + """, p as (select call_id, time_s - 0.5e0 as a, time_s + 0.5e0 as b from clicks)
 select t.call_id, count(*) as n, round(avg(case when exists (select 1 from p where p.call_id = t.call_id and greatest(0, least(p.b, t.end_s) - greatest(p.a, t.start_s)) / (greatest(p.b, t.end_s) - least(p.a, t.start_s)) >= 0.3e0) then 1.0 else 0.0 end), 6) as recall from instructions t group by 1""")
def interval_recall(spark, d):
    """C17, B9"""
    p = X.derived(spark, d, "clicks").select("call_id", (F.col("time_s") - 0.5).alias("start_s"), (F.col("time_s") + 0.5).alias("end_s"))
    return E.interval_recall(p, X.derived(spark, d, "instructions"), 0.3).select("call_id", "n", F.round("recall", 6).alias("recall"))


TOKEN = "regexp_replace(lower(word), '[^\\p{L}\\p{Nd}]', '', 'g')"


@query(core.recursive(f"with {X.WORDS_SQL}" + f""", r as (select call_id, seg_idx, row_number() over (partition by call_id, seg_idx order by word_idx) as i, {TOKEN} as token from words),
 h as (select call_id, seg_idx, row_number() over (partition by call_id, seg_idx order by word_idx) as j, case when word_idx % 11 = 5 then 'x' else {TOKEN} end as token from words where word_idx % 7 <> 3),
 size as (select call_id, seg_idx, count(*) as n from r group by 1, 2),
 grid as (select call_id, seg_idx, j, token from h union all select call_id, seg_idx, 0, null from size),
 walk as (select call_id, seg_idx, 0::bigint as i, j, j::bigint as cost from grid
  union all select call_id, seg_idx, i, j, j + min(c - j) over (partition by call_id, seg_idx order by j rows unbounded preceding)
  from (select w.call_id, w.seg_idx, r.i, w.j, case when w.j = 0 then r.i else least(w.cost + 1, lag(w.cost) over (partition by w.call_id, w.seg_idx order by w.j) + case when g.token = r.token then 0 else 1 end) end as c
   from walk w join r on w.call_id = r.call_id and w.seg_idx = r.seg_idx and r.i = w.i + 1 join grid g on g.call_id = w.call_id and g.seg_idx = w.seg_idx and g.j = w.j))
 select call_id, seg_idx, round(arg_max(cost, j) / any_value(n)::double, 6) as wer from walk join size using (call_id, seg_idx) where i = n group by 1, 2"""))
def word_error_rates(spark, d):
    """Each turn against itself with every seventh word changed or left out"""
    w = X.words(spark, d)
    hyp = F.when(F.col("word_idx") % 7 == 3, None).when(F.col("word_idx") % 11 == 5, "x").otherwise(F.col("word"))
    p = w.groupBy("call_id", "seg_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]).alias("ref"), F.transform(F.filter(F.sort_array(F.collect_list(F.struct("word_idx", hyp.alias("h")))), lambda x: x["h"].isNotNull()), lambda x: x["h"]).alias("hyp"))
    return E.word_error_rate(p).select("call_id", "seg_idx", F.round("wer", 6).alias("wer"))


#: Each word's time error against the words that follow it in the other transcript.
FOLLOWED = f"with {X.WORDS_SQL}" + f""", r as (select call_id, row_number() over (partition by call_id order by seg_idx, word_idx) as i, {TOKEN} as token, start_s from words),
 h as (select call_id, row_number() over (partition by call_id order by seg_idx, word_idx) as j, {TOKEN} as token, start_s + (word_idx % 5) * 0.01e0 as start_s from words where word_idx % 7 <> 3),
 walk as (select distinct call_id, 0::bigint as i, 1::bigint as j, null::double as off from r
  union all select w.call_id, r.i, coalesce(min(h.j) + 1, w.j), arg_min(abs(h.start_s - r.start_s), h.j)
  from walk w join r on w.call_id = r.call_id and r.i = w.i + 1 left join h on h.call_id = w.call_id and h.token = r.token and h.j between w.j and w.j + 4 group by w.call_id, r.i, w.j)"""


@query(core.recursive(FOLLOWED + """ select call_id, count(*) as n, round(avg(off), 6) as mae, round(quantile_cont(off, 0.5), 6) as median, round(quantile_cont(off, 0.9), 6) as p90, round(quantile_cont(off, 0.95), 6) as p95 from walk where off is not null group by 1"""))
def word_time_errors(spark, d):
    """D5, D6"""
    w = X.words(spark, d).withColumn("word_seq", F.col("seg_idx") * 10000 + F.col("word_idx"))
    h = w.where("word_idx % 7 <> 3").withColumn("start_s", F.col("start_s") + (F.col("word_idx") % 5) * 0.01)
    return E.word_time_errors(w, h).select("call_id", "n", *[F.round(c, 6).alias(c) for c in ("mae", "median", "p90", "p95")])


@query(core.recursive(FOLLOWED + " select p::double as point, round(error_s, 6) as error_s from (select unnest([0.5, 0.9, 0.95]) as p, unnest(quantile_cont(off, [0.5, 0.9, 0.95])) as error_s from walk where off is not null)"))
def corpus_word_time_quantiles(spark, d):
    """Over all calls"""
    w = X.words(spark, d).withColumn("word_seq", F.col("seg_idx") * 10000 + F.col("word_idx"))
    h = w.where("word_idx % 7 <> 3").withColumn("start_s", F.col("start_s") + (F.col("word_idx") % 5) * 0.01)
    return exact_quantiles(E.word_times_off(w, h), "error_s", (0.5, 0.9, 0.95)).select("point", F.round("value", 6).alias("error_s"))
