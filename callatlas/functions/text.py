"""Columns over spoken and written text: actions, targets, cleaning, flags, redaction, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U, IU = "(?U)", "(?iuU)"

# The patterns by which an instruction's action is recognised, in order; the first that is found counts.
ACTIONS = [
    ("double_click", r"doppelklick\w*|double[- ]?click\w*"),
    ("right_click", r"rechtsklick\w*|right[- ]?click\w*|rechte[rn]? maustaste"),
    ("click", r"klick\w*|anklick\w*|click\w*|dr(?:ü|ue)ck\w*|press\w*"),
    ("drag", r"zieh\w*|ziehen|drag\w*|verschieb\w*"),
    ("tap", r"tipp\w* (auf|hier|dort|da|darauf)|antipp\w*|tap\w*|touch\w*"),
    ("type", r"eingeb\w*|eintipp\w*|eintrag\w*|geben sie .{0,40}\bein\b|type\w*|enter\b"),
    ("scroll", r"scroll\w*|blätter\w*"),
    ("select", r"w[äa]hl\w*|ausw[äa]hl\w*|markier\w*|select\w*|choose\w*"),
    ("point", r"zeig\w*|point\w*|hinweis\w*|sehen sie|look at|show\w*"),
]
# Pointing words, targets, fillers, small talk, problem, cause, error, success, instruction, address, quotes, keys.
DEICTIC = r"\b(hier|hierhin|hierher|dort|dorthin|da|dies\w*|das da|diese[rsnm]?|here|there|this|that one|that)\b"
QUOTED_TARGET = "[„\"“'‚]([^\"“”'‘’]{1,40})[\"“”'‘’]"
PREPOSITION_TARGET = (
    r"\b(?:auf|on|onto|den|die|das|the)\s+(?:(?:die|den|das|the)\s+)?"
    r"(?:Schaltfläche|Button|Knopf|Reiter|Tab|Menü|Menu|Icon|Symbol|Eintrag|Link|Feld|button|tab|icon|entry|field)?\s*"
    r"([A-ZÄÖÜ][\wÄÖÜäöüß\-]*(?:\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]*){0,3})"
)
POLITE = ("Sie", "Ihnen", "Ihre", "Ihr")
FILLER = (
    r"^(?:(?:äh|ähm|ehm|uh|uhm)\b[,\s]*|(?:also|so|okay|ok|ja|nun|gut|und|um|well|right|alright|now|and)\s*,\s*)++"
    r"|\b(?:äh|ähm|ehm|uh|uhm)\b[,]?\s*"
)
SMALL_TALK = (
    r"^(?:(?:guten (?:tag|morgen|abend)|grüe?zi|hallo|hoi|servus|willkommen|vielen dank|danke(?: schön| vielmals)?|merci|auf wiederhören|auf wiedersehen|tschüss|schönen tag|einen schönen|gern geschehen|bitte schön|sehr gut|super|perfekt|alles klar|okay|ok|genau|"
    r"hello|hi|good (?:morning|afternoon|evening)|thanks?(?: you)?(?: for calling)?|you're welcome|bye|goodbye|have a (?:nice|good|great) day|great|perfect|alright)\b)"
)
OUTRO = r"\b(like and subscribe|subscribe|see you|thanks for watching|abonnier|bis zum nächsten|danke fürs zuschauen)"
PROBLEM = (
    r"\b(geht nicht|funktioniert nicht|klappt nicht|kann (?:ich )?(?:nicht|kein\w*)|lässt sich nicht|fehler\w*|fehlermeldung|meldung|problem\w*|absturz|stürzt|hängt|leer|fehlt|nicht mehr|seit (?:heute|gestern)|"
    r"doesn't work|does not work|not working|can't|cannot|won't|error|fails?|failed|crash\w*|missing|broken|problem|issue|no longer)\b"
)
CAUSE = r"\b(liegt (?:\w+ )?daran|der grund|die ursache|ursache ist|kommt daher|weil|because|the reason|is caused by|caused by|happens when)\b"
SPOKEN_ERROR = r"\b(?:fehler)?meldung(?:en)?\s*[:,]\s*([^.!?]{3,80})|\berror(?: message)?(?: says)?\s*[:,]\s*([^.!?]{3,80})"
SUCCESS = (
    r"\b(funktioniert (?:jetzt|wieder)|geht (?:jetzt|wieder)|klappt (?:jetzt|wieder)|jetzt (?:geht|funktioniert|klappt) es|sieht gut aus|ist (?:jetzt )?(?:behoben|erledigt)|ist jetzt (?:da|weg)|ist (?:da|weg)(?=[.!]?$)|"
    r"works (?:now|again)|it's working|that (?:worked|fixed it)|is (?:fixed|gone|back) now)\b"
)
INSTRUCTION = (
    r"\b(open|go to|navigate|save|copy|paste|export|install|launch|start|restart|press|hit|type|enter|select|choose|set|turn on|turn off|enable|disable|find|search|log ?in|log ?out|update|delete|"
    r"öffne\w*|geh\w* (?:sie )?(?:auf|zu|in)|speicher\w*|kopier\w*|einfüg\w*|export\w*|installier\w*|start\w*|neu ?start\w*|drück\w*|tipp\w*|wähl\w*|stell\w* (?:sie )?\w+ ein|aktivier\w*|deaktivier\w*|such\w*|meld\w* (?:sie )?(?:sich )?(?:an|ab)|aktualisier\w*|lösch\w*|setz\w*|trag\w* (?:sie )?\w+ ein)\b"
)
ADDRESS = (
    r"\b(you|you'll|you're|your|just|simply|please|sie|ihr|du|man|bitte|mal)\b"
    r"|^(open|go|click|press|select|choose|save|copy|type|öffnen|gehen|klicken|drücken|wählen|speichern)\b"
)
QUOTED = "(?<!\\w)[„\"“«‚']([^\"“”»'‘’„]{3,120})[\"“”»'‘’](?!\\w)"
NAMED_KEY = r"(?:Ctrl|Strg|Control|AltGr|Alt|Shift|Umschalt|Cmd|Command|Win(?:dows)?(?:[- ]?(?:key|Taste|logo key))?|Enter|Eingabe(?:taste)?|Return|Tab|Esc|Escape|Entf|Del|Delete|Space|Leertaste|Backspace|Pos1|F\d{1,2})"
KEY_COMBINATION = rf"\b{NAMED_KEY}(?:\s*\+\s*(?:{NAMED_KEY}|[A-Z0-9])\b)++"
# Personal data, by shape in this order, then by label, title, introduction and company.
NAME = r"\p{Lu}[\p{Ll}'-]+(?:[- ]\p{Lu}[\p{Ll}'-]+)?"
SHAPES = [
    r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,4})?\b",
    r"\b756[.\s]?\d{4}[.\s]?\d{4}[.\s]?\d{2}\b",
    r"(?:(?<![\w.+-])|\G)[\w.+-]++@[\w-]++(?:\.[\w-]++)++",  # possessive, from a run's start: linear, however long
    r"\b(?:\d[ -]?){13,19}\b",
    r"(?:\+|\b00)\d{2}[\s/.-]?\(?\d{1,4}\)?(?:[\s/.-]?\d{2,4}){2,4}\b",
    r"\b0\d{2}[\s/.-]?\d{3}[\s/.-]?\d{2}[\s/.-]?\d{2}\b",
    r"\b0\d{3,4}[\s/-]\d{3,8}\b",
]
LABELS = (
    r"Kunden(?:-?nummer|-?nr\.?)|Vertrags(?:-?nummer|-?nr\.?)|Lizenz(?:-?nummer|-?schlüssel|-?key)|Seriennummer|Mandant(?:en-?nummer)?|Benutzername|Passwort|Kennwort|"
    r"customer (?:number|no\.?|id)|account (?:number|id)|contract number|licen[cs]e (?:number|key)|serial number|user ?name|password"
)
# An identifier is word characters and hyphens, with ./@ before a word character, and holds a digit, _ or @; possessive: no step is undone.
PLAIN = r"[[\w&&[^\d_]]-]*+(?:[./](?=\w)[[\w&&[^\d_]]-]*+)*+"
ANY = r"[\w-]*+(?:[./@](?=\w)[\w-]*+)*+"
IDENTIFIER = rf"{PLAIN}(?:@(?!\w){ANY}|[\d_@]{ANY}(?:@(?!\w){ANY})?+)"
LABELLED = rf"(\b(?:{LABELS})\b\s*(?:lautet|:|=|#)\s*)([^\s,;]*[^\s.,;])|(\b(?:{LABELS})\b\s*(?:(?:ist|is)\s+)?)({IDENTIFIER})"
TITLED = rf"\b(Herrn?|Frau|Hr\.|Fr\.|Mr\.?|Mrs\.?|Ms\.?)\s+{NAME}"
INTRODUCED = rf"(\b(?:[Mm]ein Name ist|[Ii]ch hei(?:ss|ß)e|[Mm]y name is)\s+){NAME}|(\b(?:[Hh]ier ist|[Hh]ier spricht|[Tt]his is)\s+){NAME}(?=\s+(?:von|vom|bei|from|at)\b)"
COMPANY_LABELLED = rf"\b(Firma|Fa\.|[Cc]ompany)\s+{NAME}(?:\s+(?:AG|GmbH|SA|Sàrl|KG|Ltd\.?|Inc\.?))?"
COMPANY_FORM = rf"\b{NAME}(?:\s+{NAME})?\s+(?:AG|GmbH|Sàrl|KG)\b"
# Function words that tell German from English.
GERMAN_WORDS = ("und", "ich", "sie", "die", "der", "das", "nicht", "ist", "auf", "ein", "eine", "mit", "es", "wir", "den", "zu", "dann", "hier", "jetzt", "bitte", "kann", "haben")
ENGLISH_WORDS = ("the", "and", "you", "is", "to", "it", "not", "on", "a", "with", "we", "this", "that", "of", "can", "then", "here", "now", "please", "have")


def action(text: Column) -> Column:
    """The action that a text asks for, or unknown."""
    out = F.lit("unknown")
    for name, pattern in reversed(ACTIONS):
        out = F.when(text.rlike(IU + pattern), name).otherwise(out)
    return F.when(text.isNull(), None).otherwise(out)


def is_deictic(text: Column) -> Column:
    """B4"""
    return text.rlike(IU + DEICTIC)


def explicit_target(text: Column) -> Column:
    """Quoted text, else capitalised words after a preposition; a polite pronoun or a lone pointing word is none."""
    quoted = F.regexp_extract(text, IU + QUOTED_TARGET, 1)
    after = F.trim(F.regexp_extract(text, U + PREPOSITION_TARGET, 1))
    after = F.when((after == "") | after.isin(*POLITE), None).otherwise(after)
    target = F.when(quoted != "", F.trim(quoted)).otherwise(after)
    return F.when(is_deictic(target) & (F.size(F.split(target, " ")) == 1), None).otherwise(target)


def guess_language(text: Column, german: tuple[str, ...] = GERMAN_WORDS, english: tuple[str, ...] = ENGLISH_WORDS) -> Column:
    """De or en where there are three function words at least and two thirds of them speak for it, else null."""
    words = F.split(F.lower(text), r"[ ,.!?;:\n]")
    n = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    de, en = n(german), n(english)
    return F.when(de + en < 3, None).when(de >= 2 * en, "de").when(en >= 2 * de, "en")


def similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length, of trimmed lower-case texts; null: 0, both empty: 1."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(a.isNull() | b.isNull(), 0.0).when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longer)


def clean(text: Column) -> Column:
    """B2: one space between words, no fillers, no stutter, a capital first."""
    t = F.regexp_replace(F.regexp_replace(text, U + r"^\s+|\s+$", ""), U + r"\s+", " ")
    t = F.trim(F.regexp_replace(t, IU + FILLER, ""))
    t = F.regexp_replace(t, r"\s+([,.!?])", "$1")
    t = F.regexp_replace(t, IU + r"\b(\w+)( \1\b)++", "$1")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def n_words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def flags(text: Column) -> dict[str, Column]:
    """What a sentence is about."""
    return {
        "is_outro": text.rlike(IU + OUTRO),
        "is_small_talk": text.rlike(IU + SMALL_TALK),
        "is_problem": text.rlike(IU + PROBLEM),
        "is_cause": text.rlike(IU + CAUSE),
        "is_success": text.rlike(IU + SUCCESS),
        "has_instruction": text.rlike(IU + INSTRUCTION),
        "is_addressed": text.rlike(IU + ADDRESS),
    }


def error_messages(text: Column) -> Column:
    """All quoted strings, else what follows "Meldung:" or "error:"."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(U + QUOTED), F.lit(1)), F.trim)
    spoken = F.concat(F.regexp_extract(text, IU + SPOKEN_ERROR, 1), F.regexp_extract(text, IU + SPOKEN_ERROR, 2))
    spoken = clean(F.regexp_replace(spoken, "^[ ,:]+|[ ,:]+$", ""))
    return F.when(F.size(quoted) > 0, quoted).when(spoken != "", F.array(spoken)).otherwise(F.array().cast("array<string>"))


def redact(text: Column, language: Column) -> Column:
    """struct(text, count) with personal data replaced; each stage works on what the one before left."""
    token = F.when(language == "de", "[entfernt]").otherwise("[removed]")
    stages = [(U + p, "") for p in SHAPES]
    stages += [(IU + LABELLED, "$1$3"), (U + TITLED, "$1 "), (U + INTRODUCED, "$1$2")]
    # with a label the label stays, without one only the token; an unmatched group leaves no space behind
    stages.append((f"{U}(?:{COMPANY_LABELLED}|{COMPANY_FORM})", "$1\x01"))
    state = F.struct(text.alias("text"), F.lit(0).alias("count"))
    for pattern, before in stages:
        state = _stage(state, pattern, F.concat(F.lit(before), token))
    return F.transform(F.array(state), lambda s: F.struct(F.replace(F.regexp_replace(s["text"], "(Firma|Fa\\.|[Cc]ompany)\x01", "$1 "), F.lit("\x01")).alias("text"), s["count"].alias("count")))[0]


def _stage(state: Column, pattern: str, replacement: Column) -> Column:
    def run(s: Column) -> Column:
        return F.struct(F.regexp_replace(s["text"], F.lit(pattern), replacement).alias("text"), (s["count"] + F.regexp_count(s["text"], F.lit(pattern))).alias("count"))

    return F.transform(F.array(state), run)[0]


def milliseconds(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 0).cast("long")


def stamp(seconds: Column) -> Column:
    """Mm:ss,fff"""
    ms = milliseconds(seconds)
    return F.format_string("%02d:%02d,%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def short_stamp(seconds: Column) -> Column:
    """Mm:ss"""
    ms = milliseconds(seconds)
    return F.format_string("%02d:%02d", F.floor(ms / 60000), F.floor(ms / 1000) % 60)


def srt_stamp(seconds: Column) -> Column:
    """Hh:mm:ss,fff"""
    ms = milliseconds(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def slug(title: Column) -> Column:
    """Lower-case words joined by hyphens, 60 characters at most; nothing left: article."""
    t = F.lower(title)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy")
    t = F.regexp_replace(t, "[^a-z0-9]+", "-")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, 60), "-+$", "")
    return F.when(t == "", "article").otherwise(t)


def keys_as_code(text: Column) -> Column:
    """Key combinations as code spans, "Strg + C" to "`Strg` + `C`"."""
    marked = F.regexp_replace(text, U + f"({KEY_COMBINATION})", "\x01$1\x02")
    parts = F.split(marked, "\x01")

    def one(p: Column, i: Column) -> Column:
        combo, rest = F.substring_index(p, "\x02", 1), F.substring(p, F.locate("\x02", p) + 1, F.length(p))
        return F.when(i == 0, p).otherwise(F.concat(F.lit("`"), F.regexp_replace(combo, r"\s*\+\s*", "` + `"), F.lit("`"), rest))

    return F.array_join(F.transform(parts, one), "")


def first_words(text: Column, n: int = 8) -> Column:
    """The first n words, without a trailing mark; an ellipsis where more follow."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    head = F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), "[,.;:]+$", "")
    return F.when(F.size(words) > n, F.concat(head, F.lit(" …"))).otherwise(head)
