"""Call tables derived from the test data by plain expressions, in Spark and as SQL for the oracle.

A user is a call; events other than clicks are spoken instructions, clicks are seen on screen. Values come from event ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = [
    "Klicken Sie hier.",
    "Now click on the Save button.",
    "Doppelklicken Sie auf „Speichern“",
    "Bitte wählen Sie den Reiter Drucker aus.",
    "Drag this icon to the folder.",
    "Geben Sie hier den Namen ein.",
    "Das Programm startet jetzt.",
    "Scroll down to the Settings entry.",
    "Rechtsklick auf den Drucker.",
    "Press OK there.",
    "Zeigen Sie dort.",
    "Open the Menu.",
]
#: What the phrases mean: action, pointing word, spoken target.
MEANING = [
    ("click", True, None),
    ("click", False, "Save"),
    ("double_click", False, "Speichern"),
    ("select", False, "Drucker"),
    ("drag", True, None),
    ("type", True, "Namen"),
    ("unknown", False, None),
    ("scroll", False, "Settings"),
    ("right_click", False, "Drucker"),
    ("click", True, None),
    ("point", True, None),
    ("unknown", False, "Menu"),
]
SEEN = ["click", "double_click", "select", "tap", "right_click"]
SOURCES = ["cursor_tracker", "sam2", "vlm_pointing", "frame_state_change", "telemetry"]
LABELS = ["Speichern", "Save", "Drucker", "Settings", "Abbrechen", "Namen", None]
CLASSES = ["button", "icon", "text", "input", "link", "menu", "unknown"]
WIDTH, HEIGHT = 1920, 1080


def _pick(values: list, by: str, duck: bool) -> str:
    quoted = ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({by}) % {len(values)} + 1]" if duck else f"element_at(array({quoted.replace(chr(39) * 2, chr(92) + chr(39))}), cast(({by}) % {len(values)} + 1 as int))"


def _columns(duck: bool) -> dict[str, dict[str, str]]:
    pick = lambda values, by: _pick(values, by, duck)
    us = "epoch_us(ts) - 1704067200000000" if duck else "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    time = f"cast(({us}) as double) / 20000000000.0e0" if duck else f"cast(({us}) as double) / 20000000000.0D"
    dbl = (lambda x: f"cast({x} as double)") if duck else (lambda x: f"cast({x} as double)")
    x, y = "cast((event_id * 37) % 1900 as int)", "cast((event_id * 53) % 1060 as int)"
    gone = "event_id % 7 = 0"
    return {
        "instructions": {
            "call_id": "user_id", "ref_seq": "event_id", "text": pick(PHRASES, "event_id"), "anchor_s": time,
            "start_s": f"{time} - 0.8", "end_s": f"{time} + 0.2", "asr_confidence": f"{dbl('50 + event_id % 50')} / 100",
            "speaker": pick(["SPEAKER_A", "SPEAKER_B", None], "event_id"),
        },
        "clicks": {
            "call_id": "user_id", "vis_seq": "event_id", "action": pick(SEEN, "event_id"), "time_s": time,
            "x": f"case when {gone} then null else {x} end", "y": f"case when {gone} then null else {y} end",
            "point_source": f"case when {gone} then null else {pick(SOURCES, 'event_id')} end",
            "detector_confidence": f"{dbl('50 + event_id % 50')} / 100", "state_change_confidence": f"{dbl('event_id % 97')} / 96",
            "ui_interactive_confidence": f"{dbl('event_id % 11')} / 10",
        },
        "elements": {
            "call_id": "user_id", "element_seq": "event_id", "text": pick(LABELS, "event_id"), "class": pick(CLASSES, "event_id"),
            "interactive_confidence": f"{dbl('event_id % 11')} / 10", "text_confidence": f"{dbl('event_id % 13')} / 12",
            "x1": f"{x} - 20", "y1": f"{y} - 10", "x2": f"{x} + cast(20 + event_id % 40 as int)", "y2": f"{y} + 12",
            "first_seen_s": f"{time} - {dbl('event_id % 5')}", "last_seen_s": f"{time} + {dbl('event_id % 4')}",
        },
        "cursor": {
            "call_id": "user_id", "sample_seq": "event_id", "time_s": f"{time} - 0.3", "x": x, "y": y, "confidence": f"{dbl('70 + event_id % 28')} / 100",
        },
        "changes": {
            "call_id": "user_id", "change_seq": "event_id", "time_s": time, "magnitude": f"{dbl('event_id % 100')} / 100",
            "confidence": f"{dbl('30 + event_id % 69')} / 100", "x1": f"{x} - 40", "y1": f"{y} - 30", "x2": f"{x} + 40", "y2": f"{y} + 30",
        },
    }


FILTERS = {"instructions": "event_type <> 'click'", "clicks": "event_type = 'click'", "elements": "event_type = 'click' or event_id % 3 = 0", "cursor": "event_type <> 'click' or event_id % 2 = 0", "changes": "event_type = 'click'"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where(FILTERS[name]).selectExpr(*[f"{e} as {c}" for c, e in _columns(False)[name].items()])


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, duration_s): a call lasts until a second after its last event."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as call_id", f"{_columns(False)['clicks']['time_s']} as time_s")
    return t.groupBy("call_id").agg((F.max("time_s") + 1).alias("duration_s"))


def derived_sql(*names: str) -> str:
    """The leading WITH of an oracle: the named tables."""
    return "with " + ",\n".join(f"{n} as (select " + ", ".join(f"{e} as {c}" for c, e in _columns(True)[n].items()) + f" from events where {FILTERS[n]})" for n in names)


def time_sql() -> str:
    """The time in a call of a row of events, for an oracle."""
    return _columns(True)["clicks"]["time_s"]


def meaning_sql(by: str = "ref_seq") -> tuple[str, str, str]:
    """Action, pointing word and target of an instruction, as SQL picks for the oracle."""
    return tuple(_pick([m[k] for m in MEANING], by, True) for k in range(3))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, frame_key, fraction): frames of a call in the order of frame_key."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_suppkey").alias("call_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("frame_key"), F.col("l_discount").cast("double").alias("fraction"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, seg_idx, word_idx, word, start_s, end_s, speaker): turns of conversations, their words 0.3 s apart."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), F.posexplode(F.split("text", " ")).alias("word_idx", "word")).where("word <> ''").select(
        "call_id", "seg_idx", "word_idx", "word", (F.col("seg_idx") * 100 + F.col("word_idx") * 0.3).alias("start_s"), (F.col("seg_idx") * 100 + F.col("word_idx") * 0.3 + 0.3).alias("end_s"), "speaker")


WORDS_SQL = """words as (
  select call_id, seg_idx, word_idx, word, seg_idx * 100 + word_idx * 0.3e0 as start_s, seg_idx * 100 + word_idx * 0.3e0 + 0.3e0 as end_s, speaker
  from (select conv_id as call_id, turn as seg_idx, role as speaker, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as word_idx from conversations)
  where word <> '')"""


SCRIPT = [
    "Guten Tag, mein Name ist Anna Keller.",
    "Ich kann nicht mehr drucken, es kommt die Meldung: Kein Drucker zugewiesen.",
    "Das liegt daran, dass der Treiber fehlt.",
    "Klicken Sie bitte auf „Einstellungen“ und dann auf „Drucker“.",
    "Dann sehen Sie eine Liste mit allen Geräten.",
    "Öffnen Sie jetzt bitte das Menü und drücken Sie Strg + P.",
    "Meine Nummer ist 044 123 45 67 und die Kundennummer: K-4711.",
    "Now please click on the Save button.",
    "The export does not work, it says \"File is locked\".",
    "That happens because another user has it open.",
    "Please open the file menu and select Close.",
    "Ähm, das das sieht gut aus , es funktioniert jetzt wieder.",
    "Great, it works now.",
    "Vielen Dank und auf Wiederhören.",
    "You can write to help@example.com if it fails again.",
    "also, wir warten noch",
    "kurz auf den Server.",
]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: each turn of a conversation says a line of the script; words lie evenly in ten seconds, every
    fifth without times."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.element_at(F.array(*map(F.lit, SCRIPT)), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(SCRIPT) + 1).cast("int"))
    t = t.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("seg_idx"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9.5).alias("end"), line.alias("text"), F.concat(F.lit("SPEAKER_"), F.col("role")).alias("speaker"))
    step = F.lit(9.5) / F.size(F.split("text", " "))
    untimed = lambda i: (F.col("seg_idx") + i) % 5 == 0
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), F.when(~untimed(i), F.col("start") + step * i).alias("start"), F.when(~untimed(i), F.col("start") + step * (i + 1)).alias("end"), F.lit(0.9).alias("score"), F.lit(None).cast("string").alias("speaker")))
    return t.withColumn("words", words)


def segments_sql() -> str:
    """seg and said for an oracle: the segments of the scripted calls, and their words."""
    line = _pick(SCRIPT, "conv_id * 5 + turn * 3", True)
    return f"""seg as (select conv_id as call_id, row_number() over (partition by conv_id order by turn) - 1 as seg_idx, turn, turn * 10.0e0 as start_s, turn * 10.0e0 + 9.5e0 as end_s, {line} as text, 'SPEAKER_' || role as speaker from conversations),
 said as (select *, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as word_idx, 9.5e0 / len(string_split(text, ' ')) as step from seg)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript documents (call_id, language, segments) of the scripted calls."""
    s = segments(spark, sf_dir)
    item = F.struct("seg_idx", F.struct("start", "end", "text", "speaker", "words").alias("s"))
    return s.groupBy("call_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias("segments")).select("call_id", F.when(F.col("call_id") % 2 == 0, "de").otherwise("en").alias("language"), "segments")
