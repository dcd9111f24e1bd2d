"""Line dedup by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reduced, stored, table

#: Edits allowed between two lines, and the least length of a line that is compared by edits: similarity is 0.8 or more.
EDITS, LEAST = 2, 10
#: Bits of a column of the verification band.
WIDTH = 30
#: Letters that are counted before lines are compared: an edit changes at most two of them by one.
LETTERS = "etaoinsrhldcumgb"
_LID = ("h1", "h2")


def length_class(length: Column, edits: int) -> Column:
    """The least length of the class of lengths: eight classes from a power of two to the next, each wider than the edits."""
    step = F.greatest(F.lit(2 * edits + 1), F.pow(2, F.length(F.bin(length)) - 4).cast("int"))
    return (length - length % step).cast("int")


def class_keys(line: Column, low: Column, edits: int) -> Column:
    """Keys of a line among the lines of one class, whose least length is low: its edits + 1 segments, then the shifted ones.

    The first segments lie at fixed places from the start, the last ones from the end, and the middle one takes the slack.
    Of two lines within the edits some segment i of one is whole in the other with i edits before it and edits - i at
    most behind, so it is shifted by i or edits - i at most, counted from its own end. A key leaves that many characters
    out, so that a line which asks at shifts of one sign only meets all the others: with two edits 3 segments and 1 shift.
    """
    p = F.floor(low / (edits + 1)).cast("int")
    plain, shifted = [], []
    for i in range(edits + 1):
        j = edits - i
        key = lambda s, size, at, i=i: F.xxhash64(low * (edits + 1) + i, F.substring(line, at + s, size))
        if i <= j:  # from the start
            size, at = (low - p * edits if i == j else p) - i, p * i + 1
            plain.append(key(0, size, at))
            shifted += [key(s, size, at) for s in range(1, i + 1)]
        else:  # from the end
            size, at = p - j, F.length(line) - p * (j + 1) + j + 1
            plain.append(key(0, size, at))
            shifted += [key(-s, size, at) for s in range(1, j + 1)]
    return F.array(*plain, *shifted)


def with_keys(df: DataFrame, edits: int, least: int) -> DataFrame:
    """df with keys: class_keys() of line in its own class, and in the next lower one where a line shorter by the edits lies
    there; null for lines under least characters."""
    names, size, line = df.columns, F.col("size"), F.col("line")
    low = lambda n: F.greatest(length_class(F.greatest(n, F.lit(least)), edits), F.lit(least))
    df = df.select(*names, low(size).alias("own_low"), low(size - edits).alias("other_low"))
    both = F.when(F.col("other_low") < F.col("own_low"), class_keys(line, F.col("other_low"), edits)).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*names, class_keys(line, F.col("own_low"), edits).alias("own_keys"), both.alias("other_keys"))
    keys = F.when(size >= least, F.when(F.size("other_keys") > 0, F.concat("own_keys", "other_keys")).otherwise(F.col("own_keys")))
    return df.select(*names, keys.alias("keys"))


def with_letters(df: DataFrame) -> DataFrame:
    """df with letters: the numbers of the LETTERS in line modulo 16, in the bits of a long. Each letter is taken out in turn, and
    counted by the bytes that the rest of the line is shorter by; four at a step, so that each rest is made once."""
    names = df.columns
    df = df.select(*names, F.col("line").alias("rest_of_line"), F.lit(0).cast("long").alias("letters"))
    for at in range(0, len(LETTERS), 4):
        rest, packed = F.col("rest_of_line"), F.col("letters")
        for k in range(at, at + 4):
            less = F.replace(rest, F.lit(LETTERS[k]), F.lit(""))
            packed = packed + F.shiftleft((F.octet_length(rest) - F.octet_length(less)).cast("long").bitwiseAND(15), 4 * k)
            rest = less
        df = df.select(*names, rest.alias("rest_of_line"), packed.alias("letters"))
    return df.drop("rest_of_line")


def letter_difference(a: str, b: str) -> Column:
    """A lower bound of the sum of the differences: each counts the short way round."""
    one = "abs((shiftrightunsigned({a}, {k}) & 15) - (shiftrightunsigned({b}, {k}) & 15))"
    return F.expr(" + ".join(f"least({(d := one.format(a=a, b=b, k=4 * k))}, 16 - {d})" for k in range(len(LETTERS))))


def distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of two columns of character arrays, a not the shorter and at most edits longer; any value over edits
    means more than edits.

    Banded and bit-parallel: a column of the band is a word of bits, with the vertical differences +1 in p and -1 in n, and
    each character of b takes a few word operations. The score follows the band's lowest diagonal to the last row, then
    that row.
    """
    full, top = (1 << WIDTH) - 1, 1 << (WIDTH - 1)
    start = ((1 << (edits + 1)) - 1) << (WIDTH - edits - 1)
    match = " + ".join(f"if(get({a}, i + {d}) = get({b}, i), {1 << (WIDTH - 1 - (edits - d))}L, 0L)" for d in range(-edits, edits + 1))
    rows = ", ".join(f"{top >> (k + 1)}L" for k in range(2 * edits + 1))
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    d0 = f"((((m & acc.p) + acc.p) ^ acc.p) | m | acc.n) & {full}L"
    h = f"named_struct('hp', acc.n | ({full}L ^ (d | acc.p)), 'hn', d & acc.p, 'mask', get(array({rows}), greatest(i - (size({a}) - {edits}), 0)))"
    score = f"acc.s + if(i < size({a}) - {edits}, if((d & {top}L) = 0, 1, 0), if((h.hp & h.mask) <> 0, 1, 0) - if((h.hn & h.mask) <> 0, 1, 0))"
    new = f"named_struct('p', h.hn | ({full}L ^ (shiftright(d, 1) | h.hp)), 'n', shiftright(d, 1) & h.hp, 's', {score})"
    body = let("m", match, let("d", d0, let("h", h, new)))
    return F.expr(f"aggregate(sequence(0, size({b}) - 1), named_struct('p', {start}L, 'n', 0L, 's', {edits}), (acc, i) -> {body}, acc -> acc.s)")


def doc_key() -> Column:
    """Digest of a row's doc_id and text: equal rows are one document."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit(""))))


def occurrences(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """(h1, h2, place, size, keys) of every line of least characters or more, and with short of every shorter one that isn't
    blank. h1 and h2 are 128 bits of hash of the line, place is in the order of documents and lines; keys serve the edit
    join and are null for lines under least characters."""
    d = docs.select("doc_id", F.unhex(doc_key()).alias("doc_key"), F.split("text", "\n").alias("parts"))  # before lines part: once a text
    d = d.select("doc_id", "doc_key", F.posexplode("parts").alias("pos", "line")).withColumn("size", F.length("line"))
    line, size = F.col("line"), F.col("size")
    d = d.where((size >= least) | (F.lit(short) & line.rlike("\\S")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key", "pos")
    return with_keys(d, edits, least).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), place.alias("place"), "size", "keys")


def meetings(each: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, h1, h2, size, shifted) of the keys that more than one line of each has. Nearly all keys are of one line only; they
    are counted by themselves, so those lines are dealt out once and not looked at further."""
    kinds = edits + 1 + sum(min(i, edits - i) for i in range(edits + 1))
    rows = each.where("keys is not null").select(*_LID, "size", F.posexplode("keys").alias("pos", "key"))
    often = stored(rows.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key"), "keys")
    rows = rows.select("key", *_LID, "size", (F.col("pos") % kinds > edits).alias("shifted"))
    return rows.join(often.hint("merge"), "key", "left_semi")


def candidates(met: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2, g1, g2) of the lines that meet under a key, with lengths and letters within the edits.

    Each line has a row (key, h1, h2, size, letters, shifted) for each of its keys; sort-merge joins them to themselves, and
    splits a key with very many lines. Shifted keys meet plain ones only.
    """
    rows = met.select("key", *_LID, "size", "letters", "shifted")
    a, b = rows.alias("a"), rows.toDF("key", "g1", "g2", "other_size", "other_letters", "other_shifted").alias("b")
    near = (F.expr("a.key = b.key") & F.expr("h1 < g1 or h1 = g1 and h2 < g2") & F.expr("not (shifted and other_shifted)")
            & F.expr(f"abs(size - other_size) <= {edits}") & (letter_difference("letters", "other_letters") <= 2 * edits))
    return a.join(b, near).select(*_LID, "g1", "g2").distinct()


def _same_start(a: str, b: str, most: str) -> Column:
    """Length of the common prefix of two columns, by bisection with whole-string comparisons."""
    return F.expr(f"aggregate(transform(sequence(20, 0, -1), k -> cast(shiftleft(1, k) as int)), 0, (n, p) -> if(n + p <= {most} and left({a}, n + p) = left({b}, n + p), n + p, n))")


def _ends_fit(edits: int) -> Column:
    """Whether x and y, which differ in their first and last characters, can be within two edits: one edit at each end."""
    if edits > 2:
        return F.lit(True)
    ways = []
    for a, b in ((1, 1), (1, 0), (0, 1)):
        for c, d in ((1, 1), (1, 0), (0, 1)):
            cut_x, cut_y = (f"substring({z}, {1 + u}, greatest(length({z}) - {u + v}, 0))" for z, u, v in (("x", a, c), ("y", b, d)))
            ways.append(f"{cut_x} = {cut_y}")
    return F.expr("length(x) <= 2 and length(y) <= 2 or " + " or ".join(ways))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, place, line) of the lines wanted (h1, h2, place). Only documents that can hold one are shuffled."""
    per = wanted.groupBy(F.col("place.doc_key").alias("wanted_key")).agg(F.collect_set(F.struct(*_LID, "place")).alias("wanted"))
    d = docs.select("text", F.unhex(doc_key()).alias("doc_key")).where("text is not null")
    d = reduced(d, ["doc_key"], wanted.select("place.doc_key"), ["doc_key"]).dropDuplicates(["doc_key"])
    parts = d.join(per, F.col("doc_key") == F.col("wanted_key")).select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("w"))
    return parts.select("w.h1", "w.h2", "w.place", F.element_at("parts", F.col("w.place.pos") + 1).alias("line"))


def verified(texts: DataFrame, met: DataFrame, edits: int = EDITS) -> DataFrame:
    """(place, other) of the pairs met whose lines are within the edits: the first places of both.

    What both lines begin and end with is cut off, and the rest goes through the banded bit-parallel distance.
    """
    a = texts.select(*_LID, "place", F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("place").alias("other"), F.col("line").alias("b"))
    pairs = met.join(a, list(_LID)).join(b, ["g1", "g2"])
    longer = F.length("a") >= F.length("b")
    p = pairs.select("place", "other", F.when(longer, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("y"))
    for _ in range(2):  # from the start, then reversed from the end; twice reversed, the text reads forward again
        p = _once(p, "place", "other", "x", "y", _same_start("x", "y", "length(y)").alias("same"))
        p = _once(p, "place", "other", *[F.expr(f"reverse(substring({c}, same + 1))").alias(c) for c in ("x", "y")])
    p = p.where(F.expr(f"length(y) = 0 and length(x) <= {edits}") | (F.expr("length(y) > 0") & _ends_fit(edits)))
    p = _once(p, "place", "other", F.split("x", "").alias("x"), F.expr("if(y = '', cast(array() as array<string>), split(y, ''))").alias("y"))
    p = _once(p, "place", "other", F.when(F.size("y") == 0, F.size("x")).otherwise(distance("x", "y", edits)).alias("d"))
    return p.where(F.col("d") <= edits).select("place", "other")


def _once(df: DataFrame, *columns) -> DataFrame:
    """df.select(columns), computed once a row: later filters are not merged into it."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("c")).select("c.*")


def _asked(lines_: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of lines_ whose h1 and h2 are among those asked."""
    return reduced(lines_, _LID, asked, _LID).join(asked, list(_LID), "left_semi")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """(doc_key, pos) of the lines to drop: those with an earlier line, by (doc_id, doc_key, pos), that is equal or within
    the edits; lines under least characters only count as equal. A line's own fate doesn't change what it does to later ones."""
    if least < (edits + 1) * (edits // 2 + 1):
        raise ValueError(f"lines of {least} characters have no {edits + 1} segments for shifts of {edits // 2}")
    occ = stored(occurrences(docs, edits, least, short), "lines")
    each = stored(occ.groupBy(*_LID).agg(F.min("place").alias("place"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct-lines")
    met = stored(meetings(each, edits), "meetings")
    wanted = _asked(each.select(*_LID, "place"), met.select(*_LID).distinct())
    texts = stored(with_letters(line_texts(docs, stored(wanted, "wanted"))), "texts")
    pairs = stored(candidates(stored(met.join(texts.select(*_LID, "letters"), list(_LID)), "lettered"), edits), "pairs")
    texts = _asked(texts.drop("letters"), pairs.select(*_LID).union(pairs.select("g1", "g2")).distinct())
    near = verified(stored(texts, "paired"), pairs, edits).select(F.greatest("place", "other").alias("place"))
    again = each.where("n > 1").select(*_LID, F.col("place").alias("first"))
    again = occ.select(*_LID, "place").join(again, list(_LID)).where("place > first").select("place")
    return again.union(near).select("place.doc_key", "place.pos").distinct()


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text, and lines_removed.

    Lines are what stands between \\n; those of under least characters stay and take no part, unless short
    is set: then all but blank ones go where they repeat an equal line. Null text stays null. A
    text that loses all its lines becomes empty. Equal rows count as one document and are treated alike; with a null
    doc_id a row comes after all others. No rows: none. Other columns are carried along, whatever their names; one named
    lines_removed is replaced.
    """
    drops = repeated_lines(docs, edits, least, short).groupBy("doc_key").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(doc_key()).alias("doc_key"))
    j = rows.join(drops, "doc_key", "left").withColumn("parts", F.when(F.col("drops").isNotNull(), F.split("row.text", "\n")))
    # the runs of lines between those dropped
    j = j.withColumn("ends", F.expr("concat(array(-1), drops, array(size(parts)))"))
    runs = F.expr("transform(sequence(0, size(ends) - 2), i -> slice(parts, ends[i] + 2, ends[i + 1] - ends[i] - 1))")
    text = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return j.select(*[(text.alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in docs.columns if c != "lines_removed"], F.coalesce(F.size("drops"), F.lit(0)).alias("lines_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines removed, characters left and digest of the text left; null text: null digest, no rows: none."""
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return d.select("doc_id", "lines_removed", F.length("text").alias("chars_left"), F.md5("text").alias("text_digest"))
