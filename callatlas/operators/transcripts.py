"""Transcripts: readers' shapes to words, instructions from words, sentences, speech plumbing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import overlapping
from .keys import keyed

WORD = "struct<word:string,start:double,end:double,score:double,speaker:string>"
TRANSCRIPT = f"language string, segments array<struct<start:double,end:double,text:string,speaker:string,words:array<{WORD}>>>"
ANSWER = "language string, duration double, text string, words array<struct<word:string,start:double,end:double>>, segments array<struct<start:double,end:double,text:string,speaker:string>>"
LANGUAGES = {"german": "de", "deutsch": "de", "english": "en", "french": "fr", "italian": "it", "spanish": "es"}


def aligned_words(words: Column, start: Column, end: Column, speaker: Column) -> Column:
    """B1: an array of words with every time filled in: untimed words are spread evenly over the segment, an untimed start
    lowers the score to three tenths, the end isn't before the start, the speaker falls back to the segment's."""
    n = F.greatest(F.size(words), F.lit(1))
    at = lambda i: start + (end - start) * (i / n)

    def one(w: Column, i: Column) -> Column:
        s, e = F.coalesce(w["start"], at(i)), F.coalesce(w["end"], at(i + 1))
        score = F.coalesce(w["score"], F.lit(1.0)) * F.when(w["start"].isNull(), 0.3).otherwise(1.0)
        return F.struct(F.trim(w["word"]).alias("word"), s.alias("start_s"), F.greatest(e, s).alias("end_s"), score.alias("score"), F.coalesce(w["speaker"], speaker).alias("speaker"))

    return F.transform(words, one)


def segments(transcripts: DataFrame) -> DataFrame:
    """A1, B1: (call_id, seg_idx, start_s, end_s, text, speaker, words) of transcript documents."""
    s = transcripts.select("call_id", F.posexplode("segments").alias("seg_idx", "s"))
    return s.select("call_id", "seg_idx", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.trim("s.text").alias("text"), F.col("s.speaker").alias("speaker"), aligned_words(F.coalesce(F.col("s.words"), F.array().cast(f"array<{WORD}>")), F.col("s.start"), F.col("s.end"), F.col("s.speaker")).alias("words"))


def words_of(segs: DataFrame) -> DataFrame:
    return segs.select("call_id", "seg_idx", F.posexplode("words").alias("word_idx", "w")).select("call_id", "seg_idx", "word_idx", "w.*")


def language_code(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(F.length(low) == 2, low)
    for full, code in LANGUAGES.items():
        out = F.when(low == full, code).otherwise(out)
    return out


def from_answers(answers: DataFrame, hint: str | None = None) -> DataFrame:
    """Transcription answers (call_id, body) in any of three shapes as transcript documents.

    Segments get SPEAKER_ labels and, where the answer has timed words, those that start inside them, first segment first;
    else their own words without times at score 0.9. Empty segments go. Without segments the text is one.
    """
    a = answers.select("call_id", F.from_json("body", ANSWER).alias("j")).select("call_id", "j.*")
    untimed = lambda text: F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: F.struct(t.alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0.9).alias("score"), F.lit(None).cast("string").alias("speaker")))
    a = a.withColumn("words", F.filter(F.coalesce("words", F.array().cast("array<struct<word:string,start:double,end:double>>")), lambda w: F.coalesce(w["word"], F.lit("")) != ""))
    parts = F.filter(F.coalesce("segments", F.array().cast("array<struct<start:double,end:double,text:string,speaker:string>>")), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    a = a.withColumn("parts", F.transform(parts, lambda s: F.struct(F.coalesce(s["start"], F.lit(0.0)).alias("start"), F.coalesce(s["end"], s["start"], F.lit(0.0)).alias("end"), F.trim(s["text"]).alias("text"), s["speaker"].alias("speaker"))))
    first = lambda w: F.get(F.filter(F.transform("parts", lambda s, i: F.when((w["start"] >= s["start"] - 0.05) & (w["start"] < s["end"] + 0.05), i)), lambda i: i.isNotNull()), F.lit(0))
    a = a.withColumn("owner", F.transform("words", first))

    def segment(s: Column, i: Column) -> Column:
        speaker = F.when(F.coalesce(s["speaker"], F.lit("")) == "", None).when(F.upper(s["speaker"]).startswith("SPEAKER"), s["speaker"]).otherwise(F.concat(F.lit("SPEAKER_"), s["speaker"]))
        own = F.transform(F.filter(F.arrays_zip("words", "owner"), lambda z: z["owner"] == i), lambda z: F.struct(z["words"]["word"].alias("word"), z["words"]["start"].alias("start"), z["words"]["end"].alias("end"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("speaker")))
        chosen = F.when(F.size(own) > 0, own).otherwise(untimed(s["text"]))
        spoken = F.transform(chosen, lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["score"].alias("score"), speaker.alias("speaker")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), speaker.alias("speaker"), spoken.alias("words"))

    timed = F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("speaker")))
    end = F.when(F.size("words") > 0, F.coalesce(F.element_at("words", -1)["end"], F.lit(0.0))).otherwise(F.coalesce("duration", F.lit(0.0)))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), end.alias("end"), F.trim("text").alias("text"), F.lit(None).cast("string").alias("speaker"), F.when(F.size("words") > 0, timed).otherwise(untimed(F.col("text"))).alias("words")))
    given = F.coalesce(F.size("segments"), F.lit(0)) > 0
    segs = F.when(given, F.transform("parts", segment)).when(F.coalesce("text", F.lit("")) != "", whole)
    b = a.select("call_id", language_code(F.col("language")).alias("language"), F.coalesce(segs, F.array().cast(f"array<struct<start:double,end:double,text:string,speaker:string,words:array<{WORD}>>>")).alias("segments"))
    said = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    return b.select("call_id", F.coalesce("language", F.lit(hint), T.guess_language(said)).alias("language"), "segments")


# Words that part an utterance into steps.
MARKERS = ("dann", "anschließend", "danach", "zuerst", "zunächst", "then", "next", "first")


def clauses(words: list[str], has_action) -> list[tuple[int, ...]]:
    """Indices of the words of each clause. A marker word, or a comma, semicolon or full stop, ends a clause once an
    action was heard in it; a marker belongs to no clause."""
    out, held = [], []
    for i, word in enumerate(words):
        token = word.strip()
        bare = re.sub(r"\W+$", "", token).lower()
        if bare in MARKERS:
            if held and has_action([words[k] for k in held]):
                out.append(tuple(held))
                held = []
            continue
        held.append(i)
        if token.endswith((",", ";", ".")) and has_action([words[k] for k in held]):
            out.append(tuple(held))
            held = []
    return [*out, tuple(held)] if held else out


_ACTION = re.compile("|".join(f"(?:{p})" for _, p in T.ACTIONS), re.IGNORECASE)


def spoken_action(words: list[str]) -> bool:
    return _ACTION.search(" ".join(w.strip() for w in words)) is not None


def instructions(segs: DataFrame) -> DataFrame:
    """References (call_id, ref_seq, ref_id, seg_idx, ordinal, text, times, action, target, confidences).

    The splitter runs over segments as they lie, without a shuffle; all else is columns over the clause's words.
    """
    fields = "call_id long, seg_idx int, ordinal int, idx array<int>"

    def split(batches):
        for b in batches:
            rows = [(c, s, k, list(idx)) for c, s, ws in zip(b.call_id, b.seg_idx, b.words, strict=True) for k, idx in enumerate(clauses([w["word"] for w in ws], spoken_action))]
            yield pd.DataFrame(rows, columns=["call_id", "seg_idx", "ordinal", "idx"])

    # the words ride along as text only; the segment is joined back by its place within the same partition
    cut = segs.withColumn("seg_idx", F.col("seg_idx").cast("int"))
    parts = cut.select("call_id", "seg_idx", F.transform("words", lambda w: F.struct(w["word"].alias("word"))).alias("words")).where(F.size("words") > 0).mapInPandas(split, keyed(fields, segs))
    j = parts.join(cut.select("call_id", "seg_idx", "words", F.col("speaker").alias("seg_speaker")), ["call_id", "seg_idx"]).withColumn("ws", F.transform("idx", lambda i: F.get("words", i)))
    text = F.array_join(F.transform("ws", lambda w: F.trim(w["word"])), " ")
    pointing = F.filter("ws", lambda w: T.is_deictic(w["word"]))
    j = j.select("call_id", "seg_idx", "ordinal", text.alias("text"), F.col("ws")[0]["start_s"].alias("start_s"), F.element_at("ws", -1)["end_s"].alias("end_s"), F.coalesce(F.get(pointing, F.lit(0))["end_s"], F.element_at("ws", -1)["end_s"]).alias("anchor_s"), (F.size(pointing) > 0).alias("deictic"), F.coalesce("seg_speaker", F.col("ws")[0]["speaker"]).alias("speaker"), F.bround(F.aggregate("ws", F.lit(0.0), lambda a, w: a + w["score"]) / F.size("ws"), 3).alias("asr_confidence"), F.when(F.forall("ws", lambda w: w["end_s"] > w["start_s"]), 1.0).otherwise(0.5).alias("alignment_confidence"))
    j = j.withColumns({"spoken_action": T.action(F.col("text")), "explicit_target": T.explicit_target(F.col("text"))}).where("spoken_action <> 'unknown'")
    n = F.row_number().over(W.partitionBy("call_id").orderBy("seg_idx", "ordinal")) - 1
    return j.withColumn("ref_seq", n).withColumn("ref_id", F.format_string("audio_%04d", "ref_seq"))


def sentence_pieces(words: DataFrame, most: int = 40) -> DataFrame:
    """Raw sentences (call_id, seg_idx, piece, start_s, end_s, raw, speaker) of words.

    A break comes before a word whose speaker differs from the one before, after closing punctuation, and after most words.
    The speaker is the one of most words, of equal ones the first.
    """
    w = W.partitionBy("call_id", "seg_idx").orderBy("word_idx")
    ends = F.col("word").rlike(r"[.!?…]$") & ~F.col("word").rlike(r"^\d+\.$")
    breaks = (F.col("speaker") != F.lag("speaker").over(w)) | F.lag(ends).over(w)
    d = words.withColumn("run", F.sum(F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).over(w))
    d = d.withColumn("part", F.floor((F.row_number().over(W.partitionBy("call_id", "seg_idx", "run").orderBy("word_idx")) - 1) / most))
    key = ["call_id", "seg_idx", "run", "part"]
    per = d.groupBy(*key, "speaker").agg(F.count("*").alias("n"), F.min("word_idx").alias("first"), F.max("word_idx").alias("last"), F.min("start_s").alias("s0"), F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_s", "end_s"))).alias("ws"))
    named = F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("n", -F.col("first"))))
    g = per.groupBy(*key).agg(named.alias("speaker"), F.sort_array(F.flatten(F.collect_list("ws"))).alias("ws"))
    piece = F.row_number().over(W.partitionBy("call_id", "seg_idx").orderBy("run", "part")) - 1
    return g.select("call_id", "seg_idx", piece.alias("piece"), F.col("ws")[0]["start_s"].alias("start_s"), F.element_at("ws", -1)["end_s"].alias("end_s"), F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("raw"), "speaker")


SHORT = 6


def glued(pieces: DataFrame, most: int = 40) -> DataFrame:
    """Numbered sentences of cleaned pieces (call_id, seg_idx, piece, start_s, end_s, text, speaker): a short fragment joins the
    sentence before of the same speaker if that isn't closed and ends less than a second before; under three characters none counts.

    Speaker, closing mark, gap and two long neighbours part sentences whatever came before, so a window cuts calls into runs there.
    What depends on the words glued so far is folded within a run; pieces without times part too.
    """
    w = W.partitionBy("call_id").orderBy("seg_idx", "piece")
    n = T.n_words(F.col("text"))
    meets = F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & ~F.lag(F.substring("text", -1, 1)).over(w).isin(*".!?…") & (F.col("start_s") - F.lag("end_s").over(w) < 1.0) & ((F.col("n") <= SHORT) | (F.lag("n").over(w) <= SHORT))
    p = pieces.where(F.length("text") >= 3).withColumn("n", n).withColumn("run", F.sum(F.when(F.coalesce(meets, F.lit(False)), 0).otherwise(1)).over(w))
    rows = F.sort_array(F.collect_list(F.struct("seg_idx", "piece", "start_s", "end_s", "text", "n")))
    g = p.groupBy("call_id", "run").agg(rows.alias("x"), F.first("speaker").alias("speaker"))
    folded = F.expr(f"""aggregate(slice(x, 2, size(x)), struct(slice(array(struct(x[0].start_s as start_s, x[0].end_s as end_s, x[0].text as text)), 1, 0) as done, x[0].start_s as start_s, x[0].end_s as end_s, x[0].text as text, x[0].n as n),
      (a, e) -> if((a.n <= {SHORT} or e.n <= {SHORT}) and a.n + e.n <= {most + 5},
        struct(a.done as done, a.start_s as start_s, e.end_s as end_s, concat(a.text, ' ', lower(substr(e.text, 1, 1)), substr(e.text, 2)) as text, a.n + e.n as n),
        struct(concat(a.done, array(struct(a.start_s as start_s, a.end_s as end_s, a.text as text))) as done, e.start_s as start_s, e.end_s as end_s, e.text as text, e.n as n)),
      a -> concat(a.done, array(struct(a.start_s as start_s, a.end_s as end_s, a.text as text))))""")
    s = g.select("call_id", "run", "speaker", F.posexplode(folded).alias("pos", "s"))
    number = F.row_number().over(W.partitionBy("call_id").orderBy("run", "pos"))
    return s.select("call_id", number.alias("sent_no"), "s.start_s", "s.end_s", "s.text", "speaker")


def sentences(words: DataFrame, untimed: DataFrame | None = None) -> DataFrame:
    """Numbered sentences of each call. untimed: segments without words, whose text is a sentence of its own."""
    p = sentence_pieces(words).select("call_id", "seg_idx", "piece", "start_s", "end_s", T.clean(F.col("raw")).alias("text"), "speaker")
    if untimed is not None:
        p = p.union(untimed.where("trim(text) <> ''").select("call_id", "seg_idx", F.lit(0).alias("piece"), "start_s", "end_s", T.clean(F.col("text")).alias("text"), "speaker"))
    return glued(p)


def srt(segs: DataFrame) -> DataFrame:
    """(call_id, srt, plain) of each call's segments in order."""
    n = F.row_number().over(W.partitionBy("call_id").orderBy("seg_idx"))
    said = F.concat(F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "))).otherwise(F.lit("")), "text")
    s = segs.withColumns({"n": n, "said": said})
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(T.srt_stamp(F.col("start_s")), F.lit(" --> "), T.srt_stamp(F.col("end_s"))), "said", F.lit(""))
    g = s.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b"), "said"))).alias("x"))
    return g.select("call_id", F.array_join(F.transform("x", lambda e: e["b"]), "\n").alias("srt"), F.array_join(F.transform("x", lambda e: e["said"]), "\n").alias("plain"))


def overlap_speakers(pieces: DataFrame, segs: DataFrame) -> DataFrame:
    """(call_id, piece, speaker): the speaker of the segment that overlaps most, even if none does; ties to the first."""
    p = pieces.select("call_id", "piece", F.col("start_s").alias("ps"), F.col("end_s").alias("pe"))
    own = segs.select("call_id", "seg_idx", "start_s", "end_s", "speaker")
    shared = F.least("pe", "end_s") - F.greatest("ps", "start_s")
    best = lambda j: j.groupBy("call_id", "piece").agg(F.max_by("speaker", F.struct(shared, -F.col("seg_idx"))).alias("speaker"))
    found = best(overlapping(p, own, ("ps", "pe"), ("start_s", "end_s"), 60.0).where(shared >= 0))
    # a piece in a gap: the nearest segment before it or after it, by two running ends
    alone = p.join(found.select("call_id", "piece"), ["call_id", "piece"], "left_anti")
    both = alone.select("call_id", F.col("ps").alias("t"), F.lit(0).alias("kind"), "piece", "ps", "pe", F.lit(None).cast(own.schema["seg_idx"].dataType).alias("seg_idx"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.lit(None).cast("string").alias("speaker")).unionByName(
        own.select("call_id", F.col("start_s").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(p.schema["piece"].dataType).alias("piece"), F.lit(None).cast("double").alias("ps"), F.lit(None).cast("double").alias("pe"), "seg_idx", "start_s", "end_s", "speaker"))
    one = F.when(F.col("kind") == 1, F.struct("end_s", (-F.col("seg_idx")).alias("order"), "start_s", "speaker"))
    two = F.when(F.col("kind") == 1, F.struct("start_s", F.col("seg_idx").alias("order"), "end_s", "speaker"))
    w = W.partitionBy("call_id").orderBy("t", "kind")
    gap = both.withColumns({"before": F.max(one).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.min(two).over(w.rowsBetween(0, W.unboundedFollowing))}).where("kind = 0")
    near = F.array(F.when(F.col("before").isNotNull(), F.struct((F.col("before.end_s") - F.col("ps")).alias("o"), F.col("before.order").alias("k"), F.col("before.speaker").alias("speaker"))), F.when(F.col("after").isNotNull(), F.struct((F.col("pe") - F.col("after.start_s")).alias("o"), (-F.col("after.order")).alias("k"), F.col("after.speaker").alias("speaker"))))
    return found.unionByName(gap.select("call_id", "piece", F.array_max(F.filter(near, lambda x: x.isNotNull()))["speaker"].alias("speaker")))


def words_to_segments(words: DataFrame, segs: DataFrame) -> DataFrame:
    """C13 as a join: (call_id, word_idx, seg_idx), the first segment in which a word starts."""
    w = words.select("call_id", "word_idx", F.col("start_s").alias("ws"))
    j = overlapping(w, segs.select("call_id", "seg_idx", "start_s", "end_s"), ("ws", "ws"), ("start_s - 0.05D", "end_s + 0.05D"), 30.0).where("ws >= start_s - 0.05 and ws < end_s + 0.05")
    return j.groupBy("call_id", "word_idx").agg(F.min("seg_idx").alias("seg_idx"))


def speaker_clips(segs: DataFrame, speakers: int = 4, least: float = 3.0, best: float = 6.0, most: float = 10.0) -> DataFrame:
    """For the first speakers of a call with a long enough segment, the one nearest the best length, cut to most."""
    s = segs.where(F.col("speaker").isNotNull() & (F.col("end_s") - F.col("start_s") >= least))
    w = W.partitionBy("call_id", "speaker")
    s = s.withColumns({"first": F.min("seg_idx").over(w), "k": F.row_number().over(w.orderBy(F.abs(F.col("end_s") - F.col("start_s") - best), "seg_idx"))}).where("k = 1")
    s = s.withColumn("place", F.row_number().over(W.partitionBy("call_id").orderBy("first"))).where(F.col("place") <= speakers)
    return s.select("call_id", F.regexp_replace("speaker", "SPEAKER_", "").alias("name"), "start_s", F.least("end_s", F.col("start_s") + most).alias("end_s"))


def cuts(duration: float, most: float, silences: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Parts of a call; each ends at the middle of the longest pause in the last quarter of its span, else at its limit."""
    target, start, out = max(60.0, most - 120), 0.0, []
    while duration - start > target:
        limit = start + target
        near = [s for s in silences if start + 0.75 * target < (s[0] + s[1]) / 2 < limit]
        best = max(near, key=lambda s: s[1] - s[0], default=None)
        stop = limit if best is None else (best[0] + best[1]) / 2
        out.append((start, stop))
        start = stop
    return [*out, (start, duration)]


def parts(calls: DataFrame, silences: DataFrame, most: float = 1400.0) -> DataFrame:
    """(call_id, part, from_s, to_s) of each call."""
    s = silences.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("s"))
    fields = "call_id long, part int, from_s double, to_s double"

    def run(batches):
        for b in batches:
            rows = [(c, k, x, y) for c, d, ss in zip(b.call_id, b.duration_s, b.s, strict=True) for k, (x, y) in enumerate(cuts(d, most, [(e["start_s"], e["end_s"]) for e in ([] if ss is None else ss)]))]
            yield pd.DataFrame(rows, columns=["call_id", "part", "from_s", "to_s"])

    return calls.select("call_id", "duration_s").join(s, "call_id", "left").mapInPandas(run, keyed(fields, calls))


def onto_call(part_segments: DataFrame, cut_parts: DataFrame) -> DataFrame:
    """Segments of parts with their times on the whole call, numbered anew."""
    j = part_segments.join(cut_parts.select("call_id", "part", "from_s"), ["call_id", "part"])
    shift = lambda w: F.struct(w["word"].alias("word"), (w["start_s"] + F.col("from_s")).alias("start_s"), (w["end_s"] + F.col("from_s")).alias("end_s"), w["score"].alias("score"), w["speaker"].alias("speaker"))
    n = F.row_number().over(W.partitionBy("call_id").orderBy("part", "seg_idx")) - 1
    return j.select("call_id", n.alias("seg_idx"), (F.col("start_s") + F.col("from_s")).alias("start_s"), (F.col("end_s") + F.col("from_s")).alias("end_s"), "text", "speaker", F.transform("words", shift).alias("words"))
