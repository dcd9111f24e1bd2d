from pyspark.sql import functions as F

from callatlas.functions import geometry as G
from callatlas.functions import text as T
from callatlas.sources import fixtures as X


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_phrases_mean_what_the_oracle_says(spark):
    d = spark.createDataFrame([(p,) for p in X.PHRASES], "t string")
    t = F.col("t")
    got = [tuple(r) for r in d.select(T.action(t), T.is_deictic(t), T.explicit_target(t)).collect()]
    assert got == X.MEANING


def test_press_and_print_are_told_apart(spark):
    assert column(spark, ["Bitte drucken Sie das.", "Bitte drücken Sie.", "Das Impressum", None], T.action) == ["unknown", "click", "click", None]
    assert column(spark, ["Geben Sie Ihnen auf Sie", "Klicken Sie auf „da“", "auf 'OK'"], T.explicit_target) == [None, None, "OK"]


def test_cleaning(spark):
    raw = ["ähm, the  the button , please", "also, wir wir warten", "So geht das", "way, way, way", "und, ähm gut", "Der Der Knopf"]
    assert column(spark, raw, T.clean) == ["The button, please", "Wir warten", "So geht das", "Way, way, way", "Gut", "Der Knopf"]


def test_redaction(spark):
    rows = [
        ("de", "Meine Nummer ist 044 123 45 67.", "Meine Nummer ist [entfernt].", 1),
        ("de", "Kundennummer: K-4711, bitte.", "Kundennummer: [entfernt], bitte.", 1),
        ("de", "Geben Sie Ihr Passwort ein.", "Geben Sie Ihr Passwort ein.", 0),
        ("en", "Write to a.b@example.com, Mr. Smith", "Write to [removed], Mr. [removed]", 2),
        ("de", "Guten Tag, mein Name ist Anna Keller.", "Guten Tag, mein Name ist [entfernt].", 1),
        ("de", "IBAN CH93 0076 2011 6238 5295 7 und 756.1234.5678.97", "IBAN [entfernt] und [entfernt]", 2),
        ("de", "Ich bin von der Firma Muster AG.", "Ich bin von der Firma [entfernt].", 1),
        ("de", "Bei Muster GmbH geht es.", "Bei Muster GmbH geht es.".replace("Bei Muster GmbH", "[entfernt]"), 1),
        ("en", "This is Peter from support.", "This is [removed] from support.", 1),
    ]
    d = spark.createDataFrame([r[:2] for r in rows], "l string, t string")
    got = [(r["r"]["text"], r["r"]["count"]) for r in d.select(T.redact(F.col("t"), F.col("l")).alias("r")).collect()]
    assert got == [r[2:] for r in rows]


def test_errors_keys_slug_words_and_times(spark):
    assert column(spark, ['It says "File is locked" and "Retry"', "es kommt die Meldung: Kein Drucker zugewiesen.", "can't and isn't"], T.error_messages) == [["File is locked", "Retry"], ["Kein Drucker zugewiesen"], []]
    assert column(spark, ["Drücken Sie Strg + C, dann Alt+F4.", "A + B"], T.keys_as_code) == ["Drücken Sie `Strg` + `C`, dann `Alt` + `F4`.", "A + B"]
    assert column(spark, ["Rechnung lässt sich nicht drucken", "???"], T.slug) == ["rechnung-laesst-sich-nicht-drucken", "article"]
    assert column(spark, ["a b c", "one two three four, five"], lambda c: T.first_words(c, 4)) == ["a b c", "one two three four …"]
    assert column(spark, ["71.5"], lambda c: T.stamp(c.cast("double"))) == ["01:11,500"]
    assert column(spark, ["3671.25"], lambda c: T.srt_stamp(c.cast("double"))) == ["01:01:11,250"]


def test_languages(spark):
    assert column(spark, ["ich kann das nicht und sie haben es", "you can not click on the button here", "Bonjour"], T.guess_language) == ["de", "en", None]


def test_boxes(spark):
    b = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    w = G.crop_window(F.struct(F.lit(1500).alias("x"), F.lit(900).alias("y")), F.lit(1920), F.lit(1080))
    r = spark.range(1).select(G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), G.area(b(0, 0, 3, 4)), G.interval_iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)), w, G.from_crop(b(10, 20, 90, 44), w)).first()
    assert abs(r[0] - 1 / 3) < 1e-9 and r[1] == 12 and abs(r[2] - 1 / 3) < 1e-9
    assert tuple(r[4]) == (r[3]["x1"] + 10, r[3]["y1"] + 20, r[3]["x1"] + 90, r[3]["y1"] + 44)


def test_addresses_of_any_length_are_redacted_in_linear_time(spark):
    import time

    texts = ["x" * 300_000 + " @", "a@" + "b." * 50_000 + "com", "mail a.b@c.de or a@b.c+d@e.f."]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", T.U + T.SHAPES[2], "<>")).collect()]
    assert got[0] == texts[0] and got[1] == "<>" and got[2] == "mail <> or <><>." and time.time() - began < 30


def test_identifiers_match_as_the_plain_rule_does(spark):
    """The possessive pattern against the plain one, which Java runs by recursion, over short random strings."""
    import random

    r = random.Random(6)
    rows = [("".join(r.choice("ab1_@./- ") for _ in range(r.randrange(1, 12))),) for _ in range(4000)]
    plain = r"(?:[\w-]|[./@](?=\w))*[\d_@](?:[\w-]|[./@](?=\w))*"
    got = spark.createDataFrame(rows, "t string").select("t", F.regexp_extract_all("t", F.lit(T.U + T.IDENTIFIER), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(T.U + plain), F.lit(0)).alias("b"))
    assert got.where("a <> b").collect() == [] and got.where("size(a) > 0").count() > 1000


HOSTILE = [
    "Passwort " + "a." * 50_000, "Passwort " + "a-" * 50_000, "Passwort " + "1@" * 50_000, "a." * 50_000, "@." * 50_000, "A1 " * 33_000, "1 " * 50_000, "12" * 50_000, "+41 " * 25_000, " " * 100_000, "\n" * 100_000,
    "Klicken Sie " * 8_000, "„" * 100_000, "„a“" * 30_000, "'" * 100_000, "Muster " * 14_000, "Aa-" * 33_000, "Herr " * 20_000, "Firma " * 16_000, "mein Name ist " * 7_000, "auf " * 25_000, "auf den " * 12_000, "Ctrl+" * 20_000,
    "the " * 25_000, "äh " * 33_000, "wir " * 25_000, "ähm, " * 20_000, "error: " * 14_000, "Fehler " * 14_000, "x" * 100_000, "X" * 100_000, "日本" * 50_000, "CH93 0076 " * 10_000, "." * 100_000, "?! " * 33_000, "Strg + S, " * 10_000,
]


def test_no_text_kills_a_function(spark):
    """Every column over texts on 20 kB of what could make its patterns run away or overflow the stack."""
    import time

    t = F.col("t")
    d = spark.createDataFrame([(k, x[:20_000]) for k, x in enumerate(HOSTILE)], "k int, t string").repartition(4)
    began = time.time()
    out = d.select(F.length(T.clean(t)), T.redact(t, F.lit("de"))["count"], T.explicit_target(t), F.size(T.error_messages(t)), T.guess_language(t), T.action(t), T.is_deictic(t), *[v.alias(k) for k, v in T.flags(t).items()]).collect()
    assert len(out) == len(HOSTILE) and time.time() - began < 60


def test_long_labelled_values_are_redacted(spark):
    rows = [("Passwort " + "a." * 10_000 + "b1",), ("Passwort " + "a-" * 10_000,), ("password: " + "x" * 20_000 + " end",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.redact(F.col("t"), F.lit("en"))["text"]).collect()]
    assert got == ["Passwort [removed]", rows[1][0], "password: [removed] end"]
