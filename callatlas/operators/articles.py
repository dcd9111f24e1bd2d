"""Articles: draft from sentences and references, model answers, restored steps, screenshots, Markdown, packages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import overlapping
from .keys import keyed

MOST_WORDS, DETAILS = 35, 2


def refs_in_sentences(sentences: DataFrame, refs: DataFrame) -> DataFrame:
    """Sentences with refs, the references that start in the half-open span around them, in order; pointing ones are left out."""
    r = refs.where("spoken_action <> 'point'").select("call_id", "ref_seq", F.col("start_s").alias("rs"), "spoken_action", "explicit_target", "anchor_s", F.col("text").alias("said"))
    j = overlapping(sentences.select("call_id", "sent_no", "start_s", "end_s"), r, ("start_s - 0.05D", "end_s - 0.05D"), ("rs", "rs")).where("rs >= start_s - 0.05 and rs < end_s - 0.05")
    g = j.groupBy("call_id", "sent_no").agg(F.sort_array(F.collect_list(F.struct("ref_seq", "spoken_action", "explicit_target", "anchor_s", "said"))).alias("refs"))
    return sentences.join(g, ["call_id", "sent_no"], "left").withColumn("refs", F.coalesce("refs", F.array().cast(g.schema["refs"].dataType)))


def language_of(call_language: Column, wanted: Column | None = None) -> Column:
    """Article language: de or en if asked for, else de only for a German call."""
    spoken = F.when(call_language == "de", "de").otherwise("en")
    return spoken if wanted is None else F.when(wanted.isin("de", "en"), wanted).otherwise(spoken)


def instruction_text(text: Column, refs: Column) -> Column:
    """A long sentence with references becomes its cleaned clauses."""
    clauses = F.array_distinct(F.filter(F.transform(refs, lambda r: T.clean(r["said"])), lambda c: c != ""))
    joined = F.array_join(F.transform(clauses, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))), "; ")
    ended = F.when(joined == "", text).when(joined.rlike("[.!?]$"), joined).otherwise(F.concat(joined, F.lit(".")))
    return F.when((T.n_words(text) <= MOST_WORDS) | (F.size(refs) == 0), text).otherwise(ended)


def step_title(refs: Column, language: Column) -> Column:
    """From the first reference with a target, by language and action."""
    first = F.get(F.filter(refs, lambda r: r["explicit_target"].isNotNull()), F.lit(0))
    t, a = first["explicit_target"], first["spoken_action"]
    say = lambda x, y: F.concat(F.lit(x), t, F.lit(y))
    de = F.when(a == "double_click", say("Doppelklick auf „", "“")).when(a == "right_click", say("Rechtsklick auf „", "“")).when(a == "type", say("In „", "“ eingeben")).when(a == "select", say("„", "“ auswählen")).when(a == "drag", say("„", "“ ziehen")).otherwise(say("„", "“ anklicken"))
    en = F.when(a == "double_click", say('Double-click "', '"')).when(a == "right_click", say('Right-click "', '"')).when(a == "type", say('Type into "', '"')).when(a == "select", say('Select "', '"')).when(a == "drag", say('Drag "', '"')).otherwise(say('Click "', '"'))
    return F.when(first.isNull(), None).when(language == "de", de).otherwise(en)


def article_title(problem: Column, language: Column) -> Column:
    default = F.when(language == "de", "Lösung aus einem Support-Fall").otherwise("Solution from a support case")
    return F.when(F.trim(F.coalesce(problem, F.lit(""))) == "", default).otherwise(T.first_words(F.regexp_replace(problem, "[.!?]+$", ""), 12))


def distinct_first(values: Column) -> Column:
    """Entries whose lower-case form didn't come before, in order."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def keywords(refs: DataFrame, most: int = 8) -> DataFrame:
    """The first distinct spoken targets of each call, case aside."""
    t = refs.where("explicit_target is not null")
    first = t.groupBy("call_id", F.lower("explicit_target").alias("k")).agg(F.min(F.struct("ref_seq", "explicit_target")).alias("f"))
    kept = first.withColumn("n", F.row_number().over(W.partitionBy("call_id").orderBy("f.ref_seq"))).where(F.col("n") <= most)
    return kept.groupBy("call_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("f.explicit_target").alias("t")))), lambda x: x["t"]).alias("keywords"))


def draft(sentences: DataFrame, refs: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, steps) of each call. calls: call_id, language.

    The walk over a call's sentences is done with windows: the first step is the first instruction that is no unaddressed
    complaint; what comes before is problem or cause, what comes after is a step, a detail, or the confirmation.
    """
    s = refs_in_sentences(sentences, refs).withColumns(T.flags(F.col("text")))
    n_refs = F.size("refs")
    s = s.withColumn("is_instruction", (n_refs > 0) | (F.col("has_instruction") & F.col("is_addressed")))
    small = F.col("is_small_talk") & (T.n_words(F.col("text")) <= 8) & ~F.col("is_instruction") & ~F.col("is_problem") & ~F.col("is_success")
    s = s.where(~F.col("is_outro") & ~small)
    call = W.partitionBy("call_id")
    order = call.orderBy("sent_no")
    up = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("seq", F.row_number().over(order))
    least = lambda cond: F.min(F.when(cond, F.col("seq"))).over(call)
    never = F.lit(1 << 30)
    s = s.withColumn("first_step", F.coalesce(least(F.col("is_instruction") & ~(F.col("is_problem") & ~F.col("is_addressed"))), never))
    before = F.col("seq") < F.col("first_step")
    s = s.withColumn("problem0", least(F.col("is_problem") & before))
    confirms = F.col("is_success") & ~F.col("is_instruction") & (F.col("seq") > F.col("first_step"))
    reason = F.col("is_cause") & (n_refs == 0) & ~F.col("is_addressed") & ~F.coalesce(F.col("seq") == F.col("problem0"), F.lit(False)) & ~confirms
    s = s.withColumn("cause_seq", least(reason))
    used = F.coalesce(F.col("seq") == F.col("cause_seq"), F.lit(False))
    s = s.withColumns({"is_step": F.col("is_instruction") & (F.col("seq") >= F.col("first_step")) & ~used, "confirms": confirms})
    # the problem: its first sentence, the next one whatever it says, and one more complaint
    s = s.withColumn("problem1", least(before & ~used & (F.col("seq") > F.col("problem0"))))
    s = s.withColumn("problem2", least(before & ~used & (F.col("seq") > F.col("problem1")) & F.col("is_problem")))
    s = s.withColumn("fallback", least(~F.col("is_small_talk") & ~used & F.col("problem0").isNull()))
    s = s.withColumn("in_problem", F.col("seq").isin(F.col("problem0"), F.col("problem1"), F.col("problem2")) | F.coalesce(F.col("seq") == F.col("fallback"), F.lit(False)))
    # details: up to two sentences that are not long after a step, before the next step or confirmation
    s = s.withColumn("mark", F.last(F.when(F.col("is_step"), F.col("seq")).when(F.col("confirms"), F.lit(0)), ignorenulls=True).over(up))
    free = ~F.col("is_step") & ~F.col("confirms") & ~used & (F.col("mark") > 0) & (T.n_words(F.col("text")) <= 2 * MOST_WORDS)
    s = s.withColumn("detail_no", F.when(free, F.sum(F.when(free, 1).otherwise(0)).over(W.partitionBy("call_id", "mark").orderBy("seq"))))
    s = s.withColumn("detail_no", F.when(F.col("detail_no") <= DETAILS, F.col("detail_no")))
    s = s.join(calls.select("call_id", language_of(F.col("language")).alias("article_language")), "call_id")
    d = s.where("detail_no is not null").groupBy("call_id", F.col("mark").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("details"), F.max_by("end_s", "seq").alias("details_end"))
    steps = s.where("is_step").join(d, ["call_id", "seq"], "left")
    number = F.row_number().over(W.partitionBy("call_id").orderBy("seq"))
    steps = steps.select("call_id", number.alias("number"), F.lit(None).cast("string").alias("section"), step_title(F.col("refs"), F.col("article_language")).alias("title"), instruction_text(F.col("text"), F.col("refs")).alias("instruction"), "details", F.lit("customer").alias("actor"), F.col("start_s").alias("time_s"), F.coalesce("details_end", "end_s").alias("end_s"), F.transform("refs", lambda r: F.struct(r["ref_seq"].alias("ref_seq"), r["spoken_action"].alias("spoken_action"), r["anchor_s"].alias("anchor_s"))).alias("refs"))
    told = F.sort_array(F.collect_list(F.when(F.col("in_problem"), F.struct("seq", "text"))))
    a = s.groupBy("call_id", "article_language").agg(F.transform(told, lambda x: x["text"]).alias("told"), F.max(F.when(F.col("seq") == F.col("cause_seq"), F.col("text"))).alias("cause"), F.max_by("text", F.when(F.col("confirms"), F.col("seq"))).alias("verification"), F.max("end_s").alias("source_duration_s"))
    errors = distinct_first(F.flatten(F.transform("told", T.error_messages)))
    problem = F.when(F.size("told") > 0, F.array_join("told", " "))
    articles = a.join(keywords(refs), "call_id", "left").select(
        "call_id", F.col("article_language").alias("language"), article_title(F.get("told", F.lit(0)), F.col("article_language")).alias("title"), problem.alias("problem"), errors.alias("error_messages"), "cause", F.lit(None).cast("string").alias("applies_to"), "verification",
        F.when(F.col("verification").isNotNull(), True).alias("resolved"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.array().cast("array<string>").alias("notes"), "source_duration_s", F.lit("rule-based").alias("method"), F.lit(0).alias("redactions"), F.lit(False).alias("private"),
    )
    return articles, steps


def redacted(articles: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with personal data replaced in every text, and the number of places added to redactions."""
    lang = F.col("language")
    plain, lists = ["title", "problem", "cause", "applies_to", "verification"], ["error_messages", "notes", "keywords"]
    s = steps.join(articles.select("call_id", "language"), "call_id")
    fields = ["section", "title", "instruction", "details"]
    for f in fields:
        s = s.withColumn(f"{f}_r", T.redact(F.col(f), lang))
    found = sum((F.coalesce(F.when(F.col(f).isNotNull(), F.col(f"{f}_r")["count"]), F.lit(0)) for f in fields), F.lit(0))
    s = s.withColumn("found", found)
    for f in fields:
        s = s.withColumn(f, F.when(F.col(f).isNotNull(), F.col(f"{f}_r")["text"])).drop(f"{f}_r")
    per = s.groupBy("call_id").agg(F.sum("found").alias("in_steps"))
    a = articles
    for f in plain:
        a = a.withColumn(f"{f}_r", T.redact(F.col(f), lang))
    for f in lists:
        a = a.withColumn(f"{f}_r", F.transform(f, lambda x: T.redact(x, lang)))
    n = sum((F.coalesce(F.when(F.col(f).isNotNull(), F.col(f"{f}_r")["count"]), F.lit(0)) for f in plain), F.lit(0)) + sum((F.aggregate(f"{f}_r", F.lit(0), lambda x, y: x + y["count"]) for f in lists), F.lit(0))
    a = a.join(per, "call_id", "left").withColumn("redactions", F.col("redactions") + n + F.coalesce("in_steps", F.lit(0)))
    for f in plain:
        a = a.withColumn(f, F.when(F.col(f).isNotNull(), F.col(f"{f}_r")["text"])).drop(f"{f}_r")
    for f in lists:
        a = a.withColumn(f, F.transform(f"{f}_r", lambda x: x["text"])).drop(f"{f}_r")
    return a.drop("in_steps"), s.drop("found", "language")


def private(steps: DataFrame, articles: DataFrame) -> DataFrame:
    """Steps of private articles without times, points, boxes and images of screenshots."""
    s = steps.join(articles.select("call_id", "private"), "call_id")
    for c in ("screenshot_s", "point", "box", "image"):
        if c in s.columns:
            s = s.withColumn(c, F.when(~F.col("private"), F.col(c)))
    return s.drop("private")


# Headings of the article by language.
HEADINGS = {
    "de": {"problem": "Problem", "error": "Fehlermeldung", "cause": "Ursache", "applies": "Betrifft", "solution": "Lösung", "verification": "Prüfen, ob es funktioniert", "notes": "Hinweise", "support": "nur durch den Support", "review": "Automatisch aus einer Support-Aufzeichnung erstellt – bitte vor dem Veröffentlichen prüfen.", "unresolved": "Im aufgezeichneten Fall war das Problem am Ende des Gesprächs noch nicht gelöst.", "screen": "Bildschirm bei Schritt", "source": "Support-Aufzeichnung"},
    "en": {"problem": "Problem", "error": "Error message", "cause": "Cause", "applies": "Applies to", "solution": "Solution", "verification": "Check that it works", "notes": "Notes", "support": "support only", "review": "Generated automatically from a support recording – please review before publishing.", "unresolved": "In the recorded case the problem was not yet solved at the end of the call.", "screen": "Screen at step", "source": "support recording"},
}


def markdown(articles: DataFrame, steps: DataFrame, generated: str, folder: str = "images") -> DataFrame:
    """(call_id, slug, markdown). steps: number, section, title, instruction, details, actor, time_s, has_image."""
    word = lambda k: F.when(F.col("language") == "de", HEADINGS["de"][k]).otherwise(HEADINGS["en"][k])
    yaml = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    image = F.col("has_image") if "has_image" in steps.columns else F.lit(False)
    g = steps.withColumn("image_file", F.when(image, F.format_string("step-%02d.jpg", "number"))).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("number", "section", "title", "instruction", "details", "actor", "time_s", "image_file"))).alias("steps"))
    a = articles.join(g, "call_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(g.schema["steps"].dataType)))
    sections = F.size(F.array_distinct(F.filter(F.transform("steps", lambda s: s["section"]), lambda x: x.isNotNull()))) >= 2

    def step(s: Column, i: Column) -> Column:
        earlier = F.when(i > 0, F.get("steps", i - 1)["section"])
        head = F.when(sections & s["section"].isNotNull() & ~s["section"].eqNullSafe(earlier), text("### ", s["section"], "\n\n")).otherwise("")
        mark = F.when(sections, "#### ").otherwise("### ")
        title = text(mark, s["number"].cast("string"), ". ", F.coalesce(s["title"], T.first_words(s["instruction"])), F.when(s["actor"] == "support", text(" *(", word("support"), ")*")).otherwise(""), "\n\n")
        body = text(T.keys_as_code(s["instruction"]), "\n\n", F.coalesce(text(T.keys_as_code(s["details"]), "\n\n"), F.lit("")))
        shot = F.coalesce(text("![", word("screen"), " ", s["number"].cast("string"), "](", folder + "/", s["image_file"], ")\n\n"), F.lit(""))
        return text(head, title, body, shot, "<!-- video ", T.short_stamp(s["time_s"]), " -->\n\n")

    some = lambda cond, value: F.when(cond, value).otherwise("")
    front = text("---\ntitle: ", yaml(F.col("title")), "\n", some(F.size("keywords") > 0, text("tags: [", F.array_join(F.transform("keywords", yaml), ", "), "]\n")), "language: ", F.col("language"), "\nstatus: draft\n", F.coalesce(text("resolved: ", F.col("resolved").cast("string"), "\n"), F.lit("")), "source: ", yaml(text(word("source"), " (", F.col("method"), some(F.col("private"), F.lit(", private")), ")")), f"\ngenerated: {generated}\n---\n\n")
    top = text("# ", F.col("title"), "\n\n> ", word("review"), "\n\n", some(F.coalesce(~F.col("resolved"), F.lit(False)), text("> **", word("unresolved"), "**\n\n")))
    errors = F.array_join(F.transform("error_messages", lambda e: text("**", word("error"), ":** `", F.replace(e, F.lit("`"), F.lit("'")), "`\n\n")), "")
    problem = some(F.col("problem").isNotNull() | (F.size("error_messages") > 0), text("## ", word("problem"), "\n\n", F.coalesce(text(F.col("problem"), "\n\n"), F.lit("")), errors))
    cause = F.coalesce(text("## ", word("cause"), "\n\n", F.col("cause"), "\n\n"), F.lit(""))
    applies = F.coalesce(text("**", word("applies"), ":** ", F.col("applies_to"), "\n\n"), F.lit(""))
    solution = some(F.size("steps") > 0, text("## ", word("solution"), "\n\n", F.array_join(F.transform("steps", step), "")))
    check = F.coalesce(text("## ", word("verification"), "\n\n", T.keys_as_code(F.col("verification")), "\n\n"), F.lit(""))
    notes = some(F.size("notes") > 0, text("## ", word("notes"), "\n\n", F.array_join(F.transform("notes", lambda n: text("- ", T.keys_as_code(n), "\n")), ""), "\n"))
    page = text(front, top, problem, cause, applies, solution, check, notes)
    return a.select("call_id", T.slug(F.col("title")).alias("slug"), text(F.regexp_replace(page, r"\s+\z", ""), "\n").alias("markdown"))


def package(pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(call_id, path, content): the article and an image for each step that has one."""
    p = pages.select("call_id", F.concat("slug", F.lit("/article.md")).alias("path"), F.encode("markdown", "UTF-8").alias("content"))
    if images is None:
        return p
    i = images.where("image is not null").join(pages.select("call_id", "slug"), "call_id")
    return p.unionByName(i.select("call_id", F.concat("slug", F.lit("/images/"), F.format_string("step-%02d.jpg", "number")).alias("path"), F.col("image").alias("content")))


def reliable_clicks(steps: DataFrame, events: DataFrame, refs: DataFrame) -> DataFrame:
    """Observed or tracked clicks near each step whose own reference asks for a click surely enough, or whose view changed."""
    s = steps.select("call_id", "number", "time_s", F.greatest("end_s", F.col("time_s") + 0.5).alias("stop_s"))
    e = events.where("grounding_status in ('observed', 'tracked') and point is not null").select("call_id", "vis_seq", "peak_s", "point", "overall_confidence", "change", "ref_seq")
    j = overlapping(s, e, ("time_s - 0.3D", "stop_s + 1.5D"), ("peak_s", "peak_s"))
    own = refs.select("call_id", "ref_seq", F.col("start_s").alias("rs"), "spoken_action")
    j = j.join(own, ["call_id", "ref_seq"]).where("rs >= time_s - 0.05 and rs < stop_s - 0.05")
    return j.where((F.col("spoken_action").isin("click", "double_click", "right_click") & (F.col("overall_confidence") >= 0.5)) | (F.col("change") >= 0.9))


SHOT = "call_id long, number int, screenshot_s double, vis_seq long"


def place(steps: list[tuple], gap: float = 1.5) -> list[tuple]:
    """per step (start, stop, anchor, clicks) its screenshot time and click: the surest click, else the anchor, else early in
    the span; at least gap after the one before, or none. clicks: (peak, confidence, id) in event order."""
    last, out = float("-inf"), []
    for start, stop, anchor, clicks in steps:
        fit = [c for c in clicks if c[0] - 0.1 >= last + gap]
        best = max(fit, key=lambda c: c[1], default=None)
        if best is not None:
            shot, vis = max(0.0, best[0] - 0.1), best[2]
        else:
            shot, vis = anchor if anchor is not None else start + min(3.0, (stop - start) / 2), None
            if shot < last + gap:
                shot = min(stop, last + gap)
            if shot < last + gap - 0.01:
                shot = None
        if shot is not None:
            last = shot
        out.append((shot, vis))
    return out


def screenshots(steps: DataFrame, reliable: DataFrame) -> DataFrame:
    """F5 on C10: (call_id, number, screenshot_s, vis_seq)."""
    clicks = reliable.groupBy("call_id", "number").agg(F.sort_array(F.collect_set(F.struct("peak_s", "overall_confidence", "vis_seq"))).alias("clicks"))
    s = steps.select("call_id", "number", "time_s", F.greatest("end_s", F.col("time_s") + 0.5).alias("stop_s"), F.get("refs", F.lit(0))["anchor_s"].alias("anchor_s")).join(clicks, ["call_id", "number"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        given = [(r.time_s, r.stop_s, None if pd.isna(r.anchor_s) else r.anchor_s, [(c["peak_s"], c["overall_confidence"], c["vis_seq"]) for c in (r.clicks if r.clicks is not None else [])]) for r in rows.itertuples()]
        return pd.DataFrame([[rows.call_id.iloc[0], n, t, v] for n, (t, v) in zip(rows.number, place(given), strict=True)], columns=["call_id", "number", "screenshot_s", "vis_seq"]).astype({"vis_seq": "Int64"})

    return s.groupBy("call_id").applyInPandas(run, keyed(SHOT, s))


def observed_actions(events: DataFrame, language: Column, most: int = 40) -> DataFrame:
    """Lines about seen clicks: spoken ones first, then the surest, at most most a call, told in time order."""
    e = events.where("grounding_status in ('observed', 'tracked') and point is not null").withColumn("lang", language)
    k = F.row_number().over(W.partitionBy("call_id").orderBy(F.size("said").cast("boolean").desc(), F.col("overall_confidence").desc(), "peak_s", "vis_seq"))
    e = e.withColumn("k", k).where(F.col("k") <= most)
    de = F.col("lang") == "de"
    what = F.when(F.col("target_text").isNotNull(), F.when(de, F.concat(F.lit("Klick auf „"), "target_text", F.lit("“"))).otherwise(F.concat(F.lit('click on "'), "target_text", F.lit('"')))).otherwise(F.concat(F.when(de, "Klick bei (").otherwise("click at ("), F.col("point.x").cast("string"), F.lit(", "), F.col("point.y").cast("string"), F.lit(")")))
    first = F.get("said", F.lit(0))
    said = F.coalesce(F.when(de, F.concat(F.lit(" – gesagt: „"), first, F.lit("“"))).otherwise(F.concat(F.lit(' – said: "'), first, F.lit('"'))), F.lit(""))
    return e.select("call_id", "vis_seq", "peak_s", F.concat(F.lit("["), T.short_stamp(F.col("peak_s")), F.lit("] "), what, said).alias("line"))


def prompts(sentences: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """(call_id, transcript, actions): the numbered sentences and the lines about seen clicks."""
    line = F.concat(F.lit("["), F.col("sent_no").cast("string"), F.lit("] ("), T.short_stamp(F.col("start_s")), F.lit(") "), F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), "text")
    joined = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*key, "line"))), lambda x: x["line"]), "\n")
    t = sentences.withColumn("line", line).groupBy("call_id").agg(joined(["sent_no"]).alias("transcript"))
    return t if actions is None else t.join(actions.groupBy("call_id").agg(joined(["peak_s", "vis_seq"]).alias("actions")), "call_id", "left")


# The shape of a model's answer, and what it says for nothing.
ANSWER = "title string, problem string, error_messages array<string>, cause string, applies_to string, steps array<struct<section:string,title:string,instruction:string,details:string,actor:string,sentences:array<string>>>, verification string, notes array<string>, keywords array<string>, resolved string"
NOTHING = r"(?i)^(keine?|none|n/?a|null|nothing|-)\.?$"


def said(c: Column) -> Column:
    """A trimmed answer text; one that says nothing is null."""
    t = F.trim(c)
    return F.when((t == "") | t.rlike(NOTHING), None).otherwise(t)


def said_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), said), lambda x: x.isNotNull()))


def parsed_answers(answers: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, steps) of model answers (call_id, raw) that can be used; other calls are missing.

    Used is an answer that is JSON, has steps unless it says the case is unresolved, and ties half of its steps or more to
    sentences. A step without sentences takes the end of the step before it. Steps are numbered in time order.
    """
    a = answers.select("call_id", F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), ANSWER).alias("j")).where("j is not null").select("call_id", "j.*")
    a = a.withColumn("resolved", F.when(F.lower("resolved") == "true", True).when(F.lower("resolved") == "false", False))
    n = sentences.groupBy("call_id").agg(F.max("sent_no").alias("n_sentences"))
    st = a.join(n, "call_id", "left").select("call_id", F.coalesce("n_sentences", F.lit(0)).alias("n"), F.posexplode("steps").alias("k", "s")).withColumn("instruction", said(F.col("s.instruction"))).where("instruction is not null")
    numbers = F.transform(F.coalesce("s.sentences", F.array().cast("array<string>")), lambda x: F.regexp_replace(F.trim(x), r"^[\[\]]+|[\[\]]+$", "").try_cast("double"))
    ids = F.array_distinct(F.transform(F.filter(numbers, lambda v: (v >= 1) & (v <= F.col("n"))), lambda v: v.cast("int")))
    st = st.withColumn("ids", ids)
    span = st.select("call_id", "k", F.explode("ids").alias("sent_no")).join(sentences.select("call_id", "sent_no", "start_s", "end_s"), ["call_id", "sent_no"]).groupBy("call_id", "k").agg(F.min("start_s").alias("s0"), F.max("end_s").alias("e0"))
    st = st.join(span, ["call_id", "k"], "left")
    earlier = F.coalesce(F.last("e0", ignorenulls=True).over(W.partitionBy("call_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    st = st.select("call_id", "k", said(F.col("s.section")).alias("section"), said(F.col("s.title")).alias("title"), "instruction", said(F.col("s.details")).alias("details"), F.when(F.lower(F.trim("s.actor")) == "support", "support").otherwise("customer").alias("actor"), F.coalesce("s0", earlier).alias("time_s"), F.coalesce("e0", earlier).alias("end_s"), (F.size("ids") > 0).alias("anchored"))
    count = st.groupBy("call_id").agg(F.count("*").alias("n_steps"), F.sum(F.col("anchored").cast("int")).alias("n_anchored"))
    a = a.join(count, "call_id", "left")
    ok = (F.coalesce("n_steps", F.lit(0)) > 0) | (F.coalesce(F.col("resolved"), F.lit(True)) == F.lit(False))
    a = a.where(ok & (F.coalesce(F.col("n_anchored") * 2 >= F.col("n_steps"), F.lit(True))))
    bare = F.filter(F.transform(said_list(F.col("error_messages")), lambda e: F.regexp_replace(e, "^['\"„“”«»‚‘’ ]+|['\"„“”«»‚‘’ ]+$", "")), lambda e: e != "")
    art = a.select("call_id", *[said(F.col(c)).alias(c) for c in ("title", "problem", "cause", "applies_to", "verification")], bare.alias("error_messages"), said_list(F.col("notes")).alias("notes"), said_list(F.col("keywords")).alias("keywords"), "resolved")
    number = F.row_number().over(W.partitionBy("call_id").orderBy("time_s", "k"))
    return art, st.join(a.select("call_id"), "call_id", "left_semi").withColumn("number", number).drop("k", "anchored")


def chosen(drafts: DataFrame, written: DataFrame) -> DataFrame:
    """The written article where there is one, its gaps filled from the draft; else the draft."""
    w = written.select("call_id", *[F.col(c).alias(f"w_{c}") for c in written.columns if c != "call_id"], F.lit(True).alias("is_written"))
    j = drafts.join(w, "call_id", "left")
    for c in ("title", "problem", "cause", "applies_to", "verification", "resolved"):
        j = j.withColumn(c, F.coalesce(f"w_{c}", c))
    for c in ("error_messages", "keywords"):
        j = j.withColumn(c, F.when(F.size(f"w_{c}") > 0, F.col(f"w_{c}")).otherwise(F.col(c)))
    j = j.withColumns({"notes": F.coalesce("w_notes", "notes"), "method": F.when(F.col("is_written"), "language model").otherwise(F.col("method"))})
    return j.drop(*[c for c in j.columns if c.startswith("w_")], "is_written")


def missing_steps(draft_steps: DataFrame, written_steps: DataFrame, written: DataFrame) -> DataFrame:
    """C11: draft steps with a click, not before the first written step, that no written step overlaps; none of unresolved calls."""
    first = written_steps.groupBy("call_id").agg(F.min("time_s").alias("first_s")).join(written.where("resolved is null or resolved").select("call_id"), "call_id", "left_semi")
    d = draft_steps.where("point is not null").join(first, "call_id").where("time_s >= first_s").drop("first_s")
    w = written_steps.select("call_id", F.col("time_s").alias("ws"), F.greatest("end_s", F.col("time_s") + 0.01).alias("we"))
    met = overlapping(d.select("call_id", "number", "time_s", "end_s"), w, ("time_s", "end_s"), ("ws", "we"), 30.0).where("ws < end_s and time_s < we")
    return d.join(met.select("call_id", "number").distinct(), ["call_id", "number"], "left_anti")


def restored(written_steps: DataFrame, missing: DataFrame) -> DataFrame:
    """Written steps and missing ones in time order; a restored step takes section and actor of the step at or before it."""
    cols = ["call_id", "section", "title", "instruction", "details", "actor", "time_s", "end_s"]
    w = written_steps.select(*cols, F.col("number").alias("place"), F.lit(False).alias("was_restored"))
    m = missing.select("call_id", F.lit(None).cast("string").alias("section"), "title", "instruction", "details", F.lit(None).cast("string").alias("actor"), "time_s", "end_s", (F.col("number") + 1000000).alias("place"), F.lit(True).alias("was_restored"))
    u = w.unionByName(m)
    back = W.partitionBy("call_id").orderBy("time_s", "place").rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(~F.col("was_restored"), F.struct("section", "actor")), ignorenulls=True).over(back)
    u = u.withColumn("own", own).withColumns({"section": F.when(F.col("was_restored"), F.col("own.section")).otherwise(F.col("section")), "actor": F.coalesce("actor", "own.actor", F.lit("customer"))})
    return u.withColumn("number", F.row_number().over(W.partitionBy("call_id").orderBy("time_s", "place"))).drop("own", "place")


def coverage(steps: DataFrame, sentences: DataFrame) -> DataFrame:
    """Calls whose steps end before half of the speech."""
    c = steps.groupBy("call_id").agg(F.max("end_s").alias("covered_s")).join(sentences.groupBy("call_id").agg(F.max_by("end_s", "sent_no").alias("speech_s")), "call_id")
    return c.where("covered_s < 0.5 * speech_s")


def finished(written_steps: DataFrame, missing: DataFrame, languages: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, notes) of written articles. languages has a row an article: call_id, spoken, article.

    Missing steps are sentences of the call, so they are restored only into an article in the spoken language. Notes are (call_id,
    note, n, covered_s, speech_s): written with the number of written steps; restored or not_restored with the number of
    missing ones; short where the steps, restored ones too, end before half of the speech. Unknown languages are equal
    to each other only; a call without missing steps has no note of them.
    """
    known = languages.select("call_id", F.col("spoken").eqNullSafe(F.col("article")).alias("same"))
    m = missing.join(known, "call_id")
    steps = restored(written_steps, m.where("same").drop("same"))
    per = written_steps.groupBy("call_id").agg(F.count("*").alias("n"))
    none = [F.lit(None).cast("double").alias(c) for c in ("covered_s", "speech_s")]
    wrote = known.join(per, "call_id", "left").select("call_id", F.lit("written").alias("note"), F.coalesce("n", F.lit(0)).alias("n"), *none)
    left = m.groupBy("call_id", "same").agg(F.count("*").alias("n")).select("call_id", F.when(F.col("same"), "restored").otherwise("not_restored").alias("note"), "n", *none)
    short = coverage(steps, sentences).select("call_id", F.lit("short").alias("note"), F.lit(None).cast("long").alias("n"), "covered_s", "speech_s")
    return steps, wrote.unionByName(left).unionByName(short)
