"""Near-duplicate components of sets, from candidate keys: signatures are compared first, then the full sets of the pairs that are left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, stored, whole_groups

#: Characters of the texts of one side of a group.
CHUNK = 1_000_000

#: (signatures of rows i, of rows j) -> how alike each pair looks; rows of an array are signatures.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def resolve(each: DataFrame, texts: Callable[[DataFrame], DataFrame], shingles: Callable[[str], np.ndarray], alike: Alike, cut_off: float, share: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """(node, root): components of sets with share[1] * intersection >= share[0] * union, for sets linked to any other.

    each: sid, n (size of the set), signature (binary), bands (array<long>), a row for each different set. texts gives (sid, text)
    for a table of sids, and shingles() makes the set of a text again. Two sets are candidates if they share a band's key or a component of such
    keys; a pair whose signatures look alike by less than cut_off is no link; any other is decided on the full sets.

    First every set meets one set of each of its keys, the one with the most company, so that a family around one text
    joins in time linear in its size. Then only sets of one candidate component that are not joined yet meet, in
    groups of chunks. Of each set the text is fetched once.
    """
    keys = each.select("sid", F.explode("bands").alias("key"))
    company = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select(F.col("key").alias("k"), "held")
    met = stored(keys.join(company, F.col("key") == F.col("k")).select("sid", "key", "held"), "keys")
    score = met.groupBy("sid").agg(F.sum("held").alias("score")).select(F.col("sid").alias("s"), "score")
    lead = met.join(score, F.col("sid") == F.col("s")).groupBy("key").agg(F.max(F.struct("score", "sid")).alias("m")).select(F.col("key").alias("k"), F.col("m.sid").alias("v"))
    stars = stored(met.join(lead, F.col("key") == F.col("k")).where("sid <> v").select(F.greatest("sid", "v").alias("u"), F.least("sid", "v").alias("v")).distinct(), "stars")
    roots = components(stars)
    signed = stored(roots.join(each.select("sid", "n", "signature"), F.col("node") == F.col("sid")).select("root", "sid", "n", "signature"), "signed")
    near = stored(likely(stars, signed, alike, cut_off, share), "likely")
    known = stored(texts(signed.select("sid")).dropDuplicates(["sid"]), "texts")
    links = verified(near, known, shingles, share)
    apart = unjoined(signed, components(links))
    return components(links.union(stored(across(apart, known, shingles, alike, cut_off, share, chunk), "across")))


def fits(n, m, share: tuple[int, int]):
    """Whether sets of these sizes can be links at all; numbers, arrays or columns."""
    return (share[1] * n >= share[0] * m) & (share[1] * m >= share[0] * n)


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.cast(pa.binary())
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return raw.reshape(len(c), -1).copy().view(np.uint64)


def likely(edges: DataFrame, signed: DataFrame, alike: Alike, cut_off: float, share: tuple[int, int]) -> DataFrame:
    """The edges (u, v) that sizes and signatures do not rule out."""
    side = lambda x: signed.select(F.col("sid").alias(x + "s"), F.col("n").alias(x + "n"), F.col("signature").alias(x + "g"))
    e = edges.join(side("u"), F.col("u") == F.col("us")).join(side("v"), F.col("v") == F.col("vs")).where(fits(F.col("un"), F.col("vn"), share)).select("u", "v", "ug", "vg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = alike(_signatures(b.column("ug")), _signatures(b.column("vg"))) >= cut_off
                yield b.select(["u", "v"]).filter(pa.array(ok))

    return e.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, known: DataFrame, shingles: Callable[[str], np.ndarray], share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) that are links by their full sets; known: sid, text."""
    side = lambda x: known.select(F.col("sid").alias(x + "s"), F.col("text").alias(x + "t"))
    p = stored(pairs, "pairs")
    both = p.join(side("u"), F.col("u") == F.col("us")).join(side("v"), F.col("v") == F.col("vs")).select("u", "v", "ut", "vt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}  # sets of the pairs just seen: pairs of one set come together

        def get(sid: int, text: str) -> np.ndarray:
            if sid not in last:
                if len(last) > 64:
                    last.clear()
                last[sid] = shingles(text)
            return last[sid]

        for b in batches:
            ok = []
            for u, v, s, t in zip(*(b.column(c).to_pylist() for c in ("u", "v", "ut", "vt")), strict=True):
                x, y = get(u, s), get(v, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(share[1] * common >= share[0] * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return stored(both.mapInArrow(run, "u long, v long"), "links")


def unjoined(signed: DataFrame, joined: DataFrame) -> DataFrame:
    """(root, part, sid, n, signature) of the candidate components whose sets are not all in one part yet."""
    s = signed.join(joined.select("node", F.col("root").alias("part")), F.col("sid") == F.col("node"), "left").select("root", F.coalesce("part", "sid").alias("part"), "sid", "n", "signature")
    s = stored(s, "parts")
    split = s.groupBy("root").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select(F.col("root").alias("r"))
    return s.join(split, F.col("root") == F.col("r")).select("root", "part", "sid", "n", "signature")


def across(apart: DataFrame, known: DataFrame, shingles: Callable[[str], np.ndarray], alike: Alike, cut_off: float, share: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between sets of different parts of one candidate component, so many that all parts that have links are joined.

    A component of over chunk characters is cut into chunks, each pair of which is a group of its own; where both chunks
    are of one part alone there is nothing to compare, so a family that is joined already costs nothing. In a group the pairs
    that look alike are taken by falling likeness, and a pair that earlier links have joined is not looked at again: a group
    yields edges of a forest, never its pairs.
    """
    a = stored(apart.join(known.withColumnRenamed("sid", "t"), F.col("sid") == F.col("t")).drop("t").withColumn("chars", F.length("text")), "apart")
    own = a.groupBy("root", "part").agg(F.sum("chars").alias("held"))
    all_ = own.groupBy("root").agg(F.sum("held").alias("size"))
    own = own.join(all_, "root").select(F.col("root").alias("r"), F.col("part").alias("p"), "held", "size")
    a = a.join(own, (F.col("root") == F.col("r")) & (F.col("part") == F.col("p")))
    large = F.col("held") > chunk  # a part with chunks of its own; the others share those of the component
    c = F.when(large, F.pmod(F.xxhash64("sid"), F.ceil(F.col("held") / chunk))).otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("size") / chunk)))
    place = F.struct(F.when(large, F.col("part")).alias("of"), c.alias("c"))
    a = stored(a.select("root", place.alias("place"), "part", "sid", "n", "signature", "text"), "places")
    spots = a.select("root", "place").distinct()
    two = spots.join(spots.select(F.col("root").alias("r"), F.col("place").alias("other")), F.col("root") == F.col("r"))
    pair = two.where("(place < other and not (place.of is not null and place.of <=> other.of)) or (place = other and place.of is null)")
    ids = pair.select(F.xxhash64("root", "place", "other").alias("g"), "root", F.explode(F.array_distinct(F.array("place", "other"))).alias("at")).select("g", F.col("root").alias("r"), "at")
    met = a.join(ids, (F.col("root") == F.col("r")) & (F.col("place") == F.col("at"))).select("g", "part", "sid", "n", "signature", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["g"], 1024):
            sign, part, sid, n = _signatures(t.column("signature")), *(t.column(x).to_numpy() for x in ("part", "sid", "n"))
            text, links = t.column("text"), []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                links += _forest(sign[lo:hi], part[lo:hi], sid[lo:hi], n[lo:hi], text.slice(lo, hi - lo), shingles, alike, cut_off, share)
            yield pa.RecordBatch.from_arrays([pa.array([f(e) for e in links], pa.int64()) for f in (max, min)], ["u", "v"])

    return met.repartition("g").sortWithinPartitions("g", "sid").mapInArrow(run, "u long, v long").distinct()


def _forest(sign: np.ndarray, part: np.ndarray, sid: np.ndarray, n: np.ndarray, text: pa.ChunkedArray, shingles, alike: Alike, cut_off: float, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (sid, sid) of a group that join its parts as all its links do."""
    left, right, looks = [], [], []
    for x in range(len(sid) - 1):
        y = np.arange(x + 1, len(sid))
        y = y[(part[y] != part[x]) & fits(n[y], n[x], share)]
        score = alike(sign[x : x + 1], sign[y])
        ok = score >= cut_off
        left.append(np.full(int(ok.sum()), x))
        right.append(y[ok])
        looks.append(score[ok])
    if not left:
        return []
    i, j, looks = (np.concatenate(z) for z in (left, right, looks))
    order = np.argsort(-looks, kind="stable")
    root = np.unique(part, return_inverse=True)[1]
    sets = {k: shingles(text[k].as_py()) for k in np.unique(np.concatenate((i, j))).tolist()}
    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if root[x] != root[y]:
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if share[1] * common >= share[0] * (len(sets[x]) + len(sets[y]) - common):
                out.append((int(sid[x]), int(sid[y])))
                root[root == root[y]] = root[x]
    return out
