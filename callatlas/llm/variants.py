"""Spelling variants: words of a corpus that differ by one letter, found by a bit-sliced position index, and the forms they go by."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, stored, table, whole_groups

#: Least code points and occurrences of a word, and how many times as frequent a form is.
LEAST, TWICE, TIMES = 7, 2, 10
#: A document's run whose checksum this divides loses a letter.
SPOILT = 31
#: Segments that a word is cut into: one edit touches one of them, so two near words share all others.
SEGMENTS = 3
#: Words of one key that are compared in one group.
CHUNK = 4096
ONE = np.uint64(1)


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE, spoilt: int = SPOILT) -> DataFrame:
    """(word, n): distinct words of least letters or more that occur twice or more over all texts.

    A run of letters is `[A-Za-z\\u00C0-\\u00FF]+` with A-Z in lower case; where spoilt divides the checksum of
    `<doc_id>:<run>`, it loses the letter that the checksum points at. Texts are taken as Latin-1 bytes, in which every
    letter of a run is one byte. Counts are summed within a task first. Null texts have no words, a null doc_id stands
    as nothing before the colon, repeated rows count as often as they come. No rows: none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        for b in pieces(batches, "text"):
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for w, times in Counter(found.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % spoilt == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least:
                            continue
                    n[w] += times
            if len(n) > 200_000:
                yield out()
                n.clear()
        yield out()

    d = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def segment(c, k, segments: int = SEGMENTS):
    """(letters before, letters after) segment k of the words of c - 1 or c letters; numbers or arrays."""
    return (c - 1) * k // segments, (c - 1) - (c - 1) * (k + 1) // segments


def hits(letters: np.ndarray, group: np.ndarray, index: np.ndarray, query: np.ndarray, entries: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j): query row i has as many letters as letters has columns, and index row j of its group is one
    replaced letter, or one deleted letter, away. Rows are sorted by group; shorter words end in a zero.

    Index rows are lanes of 64-bit words, and for each position and letter a plane of such words holds which rows have it
    there. A query goes through the planes of its letters with three sets of lanes: no error so far, one letter replaced,
    one letter of its own left out, which reads the planes shifted by one position.
    """
    c = letters.shape[1]
    alphabet, ids = np.unique(letters, return_inverse=True)
    ids = ids.reshape(letters.shape)
    lanes = np.flatnonzero(index)
    place = np.arange(len(lanes))
    word, bit = place // 64, ONE << (place % 64).astype(np.uint64)
    planes = np.zeros((c, len(alphabet), len(lanes) // 64 + 1), np.uint64)
    for p in range(c):
        np.bitwise_or.at(planes[p], (ids[lanes, p], word), bit)
    short = planes[c - 1][np.searchsorted(alphabet, 0)] if alphabet[0] == 0 else np.zeros(planes.shape[2], np.uint64)
    used = np.zeros(planes.shape[2], np.uint64)
    np.bitwise_or.at(used, word, bit)
    queries = np.flatnonzero(query & (letters[:, c - 1] != 0))
    first, last = np.searchsorted(group[lanes], group[queries], side="left"), np.searchsorted(group[lanes], group[queries], side="right")
    queries, first, last = (x[last > first] for x in (queries, first, last))
    meets = (last - 1) // 64 - first // 64 + 1
    ends = np.cumsum(meets)
    left, right, at = [], [], 0
    while at < len(queries):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries, side="right")))
        m = meets[at:stop]
        q = np.repeat(queries[at:stop], m)
        w = np.repeat(first[at:stop] // 64, m) + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)
        none, replaced, shifted = used[w], np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for p in range(c):
            here = planes[p][ids[q, p], w]
            shifted = none | (shifted & planes[p - 1][ids[q, p], w]) if p else none
            replaced = (replaced & here) | (none & ~here)
            none = none & here
        near = (replaced & ~short[w]) | (shifted & short[w])
        hit = np.flatnonzero(near)
        e, lane = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[hit[e]], lanes[w[hit[e]] * 64 + lane]
        same = group[i] == group[j]
        left.append(i[same])
        right.append(j[same])
        at = stop
    no = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (no, no)


def first_key(letters: np.ndarray, i: np.ndarray, j: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The first segment but for which the words of rows i and j, near each other, agree."""
    c = letters.shape[1]
    a, b = letters[i], letters[j]
    short = b[:, -1] == 0
    ahead = np.logical_and.accumulate(a == b, axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a[:, 1:] == np.where(short[:, None], b[:, :-1], b[:, 1:]))[:, ::-1], axis=1).sum(axis=1)
    out = np.full(len(i), segments)
    for k in range(segments - 1, -1, -1):
        before, after = segment(c, k, segments)
        out[(ahead >= before) & (back >= after)] = k
    return out


def near_words(vocabulary: DataFrame, segments: int = SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """(word, near, near_n): every two words of vocabulary (word, n) that differ by one inserted, deleted or replaced code
    point, both ways, once each. Words are distinct and of three letters or more.

    Words of c - 1 and c letters meet in class c, under a key for each segment made of all letters but those of the
    segment. A key with over chunk words is cut into chunks, each of which meets each other in a group of its own. A pair is
    told under the first of its keys, so nothing is made twice.
    """
    k = f"transform(sequence(0, {segments - 1}), k -> named_struct('c', c, 'k', k, 'before', int((c - 1) * k div {segments}), 'after', int((c - 1) - (c - 1) * (k + 1) div {segments})))"
    keys = F.expr(f"flatten(transform(array(length(word), length(word) + 1), c -> {k}))")
    part = F.xxhash64("s.c", "s.k", F.expr("left(word, s.before)"), F.expr("right(word, s.after)"))
    rows = vocabulary.select("word", "n", F.explode(keys).alias("s")).select("word", "n", "s.c", "s.k", part.alias("g"))
    hot = rows.groupBy("g").agg(F.count("*").alias("held")).where(F.col("held") > chunk).select(F.col("g").alias("hot"), F.ceil(F.col("held") / chunk).cast("int").alias("parts"))
    met = rows.join(hot, F.col("g") == F.col("hot"), "left").withColumn("mine", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    one, none, all_ = F.array(F.struct(F.lit(3).alias("role"), F.lit(0).alias("i"), F.lit(0).alias("j"))), F.col("parts").isNull(), "sequence(0, parts - 1)"
    roles = F.expr(f"concat(transform({all_}, x -> named_struct('role', 1, 'i', mine, 'j', x)), transform({all_}, x -> named_struct('role', 2, 'i', x, 'j', mine)))")
    met = met.withColumn("r", F.explode(F.when(none, one).otherwise(roles))).select("c", "g", "r.i", "r.j", "r.role", "k", "word", "n")
    key = ["c", "g", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            c, role, kk, n = (t.column(x).to_numpy() for x in ("c", "role", "k", "n"))
            names = t.column("word").to_pylist()
            edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for a, z in zip(edges, edges[1:], strict=False):
                letters = np.array(names[a:z], f"<U{c[a]}").view(np.uint32).reshape(z - a, c[a])
                i, j = hits(letters, group[a:z], role[a:z] & 1 > 0, role[a:z] & 2 > 0)
                mine = first_key(letters, i, j, segments) == kk[a:z][i]
                i, j = i[mine] + a, j[mine] + a
                back = c[j] > np.array([len(names[x]) for x in j.tolist()], np.int64)  # a shorter word asks nothing in this class
                u, v = np.concatenate((i, j[back])), np.concatenate((j, i[back]))
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in u.tolist()], pa.string()), pa.array([names[x] for x in v.tolist()], pa.string()), pa.array(n[v], pa.int64())], ["word", "near", "near_n"])

    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "word string, near string, near_n long")


def forms(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for vocabulary (word, n).

    form is the near word of largest n, of equals the first in code-point order, if its n is times the word's own or more.
    root follows forms to the last: as n grows tenfold at each step, chains are short, and they are followed by doubling.
    No rows: none.
    """
    near = near_words(vocabulary)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    top = -F.col("b.m")
    own = F.when(top >= times * F.col("n"), F.col("b.near"))
    v = vocabulary.join(best.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    v = stored(v.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), own.alias("form"), F.when(own.isNotNull(), top).alias("form_n")), "forms")
    chain = cut(v.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("w"), F.col("root").alias("further"))
        moved = cut(chain.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        chain = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    last = chain.select(F.col("word").alias("w"), "root")
    return v.join(last, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with the form and the root that it goes by."""
    return forms(stored(words(table(spark, sf_dir, "documents")), "words")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 over the bytes of a string, by the table that its polynomial gives.
OP13_SQL = r"""
with recursive bits(i, k, v) as (
  select i, 0, i::bigint from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as materialized (select list(v order by i) as t from bits where k = 8),
runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 7 group by all),
bytes as (
  select *, encode(coalesce(doc_id::varchar, '') || ':' || run) as b from runs),
sums as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::int, 2))::bigint)),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) as h from bytes, tab),
words as materialized (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n
  from sums group by 1 having length(word) >= 7 and sum(n) >= 2),
gaps as materialized (
  select word, length(word) as m, i, left(word, i::int) || substr(word, i::int + 2) as rest from words, range(length(word)) t(i)),
near as materialized (
  select distinct a.word, b.word as near from gaps a join gaps b on a.m = b.m and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word from gaps a join words b on a.rest = b.word
  union select b.word, a.word from gaps a join words b on a.rest = b.word),
ranked as (
  select e.word, w.n as near_n, near, count(*) over (partition by e.word) as n_near,
    row_number() over (partition by e.word order by w.n desc, encode(near)) as r
  from near e join words w on w.word = e.near),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * w.n then near end as form, case when near_n >= 10 * w.n then near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.r = 1),
chain(word, root) as (
  select word, form from formed where form is not null
  union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null)
select f.word, f.form, coalesce(l.root, f.word) as root, f.n, f.n_near, f.form_n
from formed f left join (select c.word, c.root from chain c join formed g on g.word = c.root where g.form is null) l on l.word = f.word
"""
