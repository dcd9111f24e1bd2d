"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison within blocks, linked components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, pieces, table
from .lines import doc_key

ZERO = np.uint64(0)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; no word: zero."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 8192):
        cuts = zip(starts[at : min(at + 8192, n)].tolist(), ends[at + k - 1 : min(at + 8192, n) + k - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in cuts], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of docs, fp the 64 bits as a signed long; keyed: with doc_key, the digest of a row's doc_id and text."""
    more = [F.unhex(doc_key()).alias("doc_key")] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            key = [b.column("doc_key")] if keyed else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps), *key], ["doc_id", "fp", *["doc_key"] * keyed])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, fp long" + ", doc_key binary" * keyed)


def within(groups: np.ndarray, fps: np.ndarray, radius: int, step: int = 8, entries: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) in one group whose fingerprints differ in at most radius bits; rows are sorted by group.

    Bit planes are stored vertically: a group's fingerprints fill words of 64 lanes, and plane b of a word holds bit b of
    its lanes. A query meets each word of its group; the difference of every plane goes into saturating carry-save
    counters of 64 lanes at once. After every few planes the (query, word) entries in which all lanes exceed the radius
    are abandoned.
    """
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    words = -(-count // 64)
    base = np.concatenate(([0], np.cumsum(words)[:-1]))
    of = np.repeat(np.arange(len(first)), count)
    place = np.arange(n) - first[of]
    word, lane = base[of] + place // 64, place % 64
    lanes = np.zeros((int(words.sum()), 64), np.uint64)
    lanes[word, lane] = fps
    index = np.full(lanes.shape, -1, np.int64)
    index[word, lane] = np.arange(n)
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = [pack(((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(64)]
    used = pack((index >= 0).astype(np.uint8))
    size = (radius + 1).bit_length()
    left, right = [], []
    meets = words[of] - place // 64  # from the query's own word on: each pair is met once
    ends = np.cumsum(meets)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries, side="right")))
        m = meets[at:stop]
        q = np.repeat(np.arange(at, stop), m)
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)
        bits = fps[q]
        counts = [np.zeros(len(q), np.uint64) for _ in range(size)]
        over = ~used[w]
        for b in range(64):
            carry = planes[b][w] ^ (ZERO - ((bits >> np.uint64(b)) & np.uint64(1)))
            for c in range(size):
                counts[c], carry = counts[c] ^ carry, counts[c] & carry
            over |= carry
            if b % step == step - 1:
                alive = np.flatnonzero((over | _above(counts, radius)) != ALL)
                if len(alive) < len(q):
                    q, w, bits, over, counts = q[alive], w[alive], bits[alive], over[alive], [c[alive] for c in counts]
                if not len(q):
                    break
        if len(q):
            near = ~(over | _above(counts, radius))
            hit, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[hit], index[w[hit], bit]
            left.append(i[j > i])
            right.append(j[j > i])
        at = stop
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _above(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save counter holds more than radius."""
    more, same = np.zeros_like(counts[0]), np.full_like(counts[0], ALL)
    for c in range(len(counts) - 1, -1, -1):
        if radius >> c & 1:
            same &= counts[c]
        else:
            more |= same & counts[c]
            same &= ~counts[c]
    return more


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        if not (differ := a != b).any():
            break
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def links(fps: DataFrame, radius: int = 2, chunk: int = 512) -> DataFrame:
    """(u, v): edges between distinct fingerprints of column fp that join all pairs within the radius.

    The bits are cut into radius + 2 blocks; two fingerprints within the radius agree on two blocks at least, so they meet
    under one of the keys made of two blocks. A key with more than chunk fingerprints is cut into chunks by hash, and each
    pair of chunks is a group of its own, so no group holds more than about two chunks. A group yields edges of a forest
    with the same components as its links: one row a fingerprint at most, never its pairs.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1)
    keys = [F.struct(F.lit(i * n + j).alias("t"), block(i).alias("a"), block(j).alias("b")) for i in range(n) for j in range(i + 1, n)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    many = rows.groupBy("t", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    met = rows.join(many, ["t", "a", "b"]).withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("fp", "t", "a", "b", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"))
    key = ["t", "a", "b", "c", "d"]
    met = met.withColumn("g", F.xxhash64(*key)).select("fp", "g", *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(held: list[pa.RecordBatch], last: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t.column(c).to_numpy() for c in key]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            keep = t.num_rows if last else int(np.flatnonzero(new)[-1])
            rest = [t.slice(keep).to_batches()] if keep < t.num_rows else []
            f = t.column("fp").to_numpy()[:keep].view(np.uint64)
            if not keep:
                return held, None
            i, j = within(np.cumsum(new)[:keep], f, radius)
            root = forest(keep, i, j)
            moved = np.flatnonzero(root != np.arange(keep))
            u, v = f[moved].view(np.int64), f[root[moved]].view(np.int64)
            return [x for y in rest for x in y], pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held, out = closed([*held, b], False)
                if out is not None:
                    yield out
        if held:
            yield closed(held, True)[1]

    return met.repartition(*key).sortWithinPartitions(*key, "fp").select("fp", *key).mapInArrow(run, "u long, v long").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over fingerprints within the radius.

    Null and empty texts have fingerprint zero, linked like any other. Equal texts share a fingerprint and are compared
    once. Null doc_ids are returned but never name a component, unless it has no other. Repeated rows are returned as
    often as given. Other columns take no part. No rows: none.
    """
    return _near(cut(with_fingerprint(docs, shingle, seed)), radius).select("doc_id", "fp", "component_id")


def _near(marked: DataFrame, radius: int) -> DataFrame:
    """marked with component_id."""
    each = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(each, radius))
    own = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return marked.join(named, marked["fp"] == named["f"]).drop("f")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """docs without those that are not the first, by (doc_id, digest), of their near-duplicate component; equal rows stay once.

    Rows are told apart by doc_id and text, so null and repeated doc_ids lose nothing by themselves."""
    found = _near(cut(with_fingerprint(docs, shingle, seed, keyed=True)), radius)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key")
    stay = found.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.doc_key").alias("kept_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(doc_key()).alias("near_key"))
    return rows.join(stay, F.col("near_key") == F.col("kept_key"), "left_semi").dropDuplicates(["near_key"]).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, as near_duplicates() gives them."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
