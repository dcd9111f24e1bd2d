"""Near-duplicates of 0.8 or more: SimHash fingerprints of five-word shingles compared bit-sliced within groups of candidates,
and an exact check of the Jaccard similarity of the pairs within the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lean, pieces, reduced
from .lines import doc_key
from .simhash import within

#: Words of a shingle, and the least Jaccard similarity of near-duplicates.
SHINGLE, LEAST = 5, 0.8
#: A pair is a candidate if all ROWS least hashes of one of BANDS agree: 99.9 % of pairs at 0.8, more above.
BANDS, ROWS = 24, 6
#: Bits of 64 that the fingerprints of a pair may differ in: at 0.8 about 10 do, with a deviation of 3.
RADIUS = 26
#: Characters of the texts of one side of a group.
CHUNK = 2_000_000
#: Bytes of text that are hashed at a time.
PIECE = 2_000_000
_RNG = np.random.default_rng(42)
SALT, FACTOR = (_RNG.integers(0, 2**63, (BANDS * ROWS, 1)).astype(np.uint64) for _ in range(2))
FACTOR = FACTOR * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted 64-bit digests of the distinct shingles of a text; a text of fewer words is one shingle, no word: none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in cuts), np.uint64, len(words) - k + 1))


def bands(h: np.ndarray) -> list[int]:
    """A key for each band of least hashes of a set; the empty set has none."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[None, at : at + 1024] ^ SALT) * FACTOR).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(h: np.ndarray) -> np.uint64:
    """64-bit SimHash of a set of digests: a bit is 1 where it is set in over half of them."""
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]


def near(sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i > j) of a forest that joins all sets with a Jaccard similarity of least or more.

    The sets' fingerprints are compared bit-sliced, block by block; of the pairs within the radius each set meets, in
    order, one of every component that it is not in yet, until the exact similarity of a pair joins the two.
    """
    n = len(sets)
    full = np.array([k for k in range(n) if len(sets[k])], np.int64)
    left, right, root = [], [], np.arange(n)
    if len(full) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fps = np.array([fingerprint(sets[k]) for k in full], np.uint64)
    for j, i in blocks(fps, radius):
        i, j = full[i], full[j]
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        edges = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)])) if len(i) else [0]
        for a, z in zip(edges, edges[1:], strict=False):
            me, others = int(i[a]), j[a:z]
            while len(others := others[root[others] != root[me]]):
                one = int(others[0])
                both = len(np.intersect1d(sets[me], sets[one], assume_unique=True))
                if both >= least * (len(sets[me]) + len(sets[one]) - both) - 1e-9:
                    left.append(me)
                    right.append(one)
                    low, high = sorted((root[me], root[one]))
                    root[root == high] = low
                else:
                    others = others[1:]
    return np.array(left, np.int64), np.array(right, np.int64)


def blocks(fps: np.ndarray, radius: int, size: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within the radius, a pair of blocks of fingerprints at a time."""
    for a in range(0, len(fps), size):
        for b in range(0, a + 1, size):
            rows = np.arange(a, min(a + size, len(fps)))
            if b < a:
                rows = np.concatenate((np.arange(b, b + size), rows))
            i, j = within(np.zeros(len(rows), np.int64), fps[rows], radius)
            i, j = rows[i], rows[j]
            cross = (i < a) & (j >= a) if b < a else i < j
            yield i[cross], j[cross]


def with_bands(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, sid, bands): sid is a digest of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(pieces(batches, "text", PIECE)):
            sid, keys = np.zeros(b.num_rows, np.uint64), []
            for k, t in enumerate(b.column("text").to_pylist()):
                h = shingles(t)
                sid[k] = xxhash.xxh64_intdigest(h.tobytes())
                keys.append(np.array(bands(h), np.uint64).view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column("doc_key"), b.column("doc_id").cast(pa.int64()), pa.array(sid.view(np.int64)), flat], ["doc_key", "doc_id", "sid", "bands"])

    return docs.select(F.unhex(doc_key()).alias("doc_key"), "doc_id", "text").mapInArrow(run, "doc_key binary, doc_id long, sid long, bands array<long>")


def links(members: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(u, v): edges that join all sets of one root with a similarity of least or more. members: root, sid, text.

    A root with more than chunk characters is cut into chunks by hash, and each pair of chunks is a group of its own.
    """
    many = members.groupBy("root").agg(F.ceil(F.sum(F.length("text")) / chunk).cast("int").alias("parts"))
    met = members.join(many, "root").withColumn("mine", F.pmod(F.xxhash64("sid"), F.greatest("parts", F.lit(1))).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, greatest(parts, 1) - 1)")))
    met = met.select("root", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"), "sid", "text")

    def run(t: pa.Table) -> pa.Table:
        sid = t.column("sid").to_numpy()
        i, j = near([shingles(x) for x in t.column("text").to_pylist()], least)
        return pa.table({"u": pa.array(sid[i], pa.int64()), "v": pa.array(sid[j], pa.int64())})

    # dealt by all three: a root with many chunks spreads over tasks
    return met.repartition("root", "c", "d").groupBy("root", "c", "d").applyInArrow(run, "u long, v long").where("u <> v").distinct()


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those that are not the first, by (doc_id, digest), of their component of near-duplicates.

    Rows are told apart by doc_id and text, so a null or repeated doc_id loses nothing by itself; equal rows stay once.
    Sets of shingles are compared once where equal; texts without words are equal. Components of candidates are linear
    edges to the least set of a band; which of their members are near-duplicates is decided by exact similarity alone.
    """
    marked = cut(with_bands(docs))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key")
    each = cut(marked.groupBy("sid").agg(F.min(F.struct(place.alias("p"), "bands")).alias("m")).select("sid", F.col("m.p").alias("first"), F.col("m.bands").alias("bands")))
    keys = each.select("sid", F.explode("bands").alias("key"))
    met = keys.groupBy(F.col("key").alias("k")).agg(F.min("sid").alias("v"), F.count("*").alias("n")).where("n > 1")
    roots = components(keys.join(met, F.col("key") == F.col("k")).where("sid <> v").select(F.col("sid").alias("u"), "v").distinct())
    wanted = each.join(roots, F.col("sid") == F.col("node")).select("sid", "root", F.col("first.doc_key").alias("wanted_key"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(doc_key()).alias("near_key"))
    members = reduced(keyed, ["near_key"], wanted, ["wanted_key"]).join(wanted, F.col("near_key") == F.col("wanted_key")).select("root", "sid", "row.text").dropDuplicates(["sid"])
    found = components(links(cut(members), least))
    own = each.join(found, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid").alias("r")).agg(F.min("first").alias("first"))
    stay = own.select(F.col("first.doc_key").alias("kept_key"))
    return keyed.join(stay, F.col("near_key") == F.col("kept_key"), "left_semi").dropDuplicates(["near_key"]).select("row.*")
