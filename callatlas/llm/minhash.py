"""b-bit MinHash near-duplicates: low bits of minima packed into signatures, compared by bit counts, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stored, table
from .families import resolve
from .lines import doc_key
from .similar import shingles

#: Words of a shingle; links have DEN * intersection >= NUM * union.
SHINGLE, NUM, DEN = 3, 85, 100
#: A pair is a candidate if all ROWS minima of one of BANDS agree: at 0.85 all but 1 in 10^5 pairs are.
BANDS, ROWS = 24, 6
#: Low bits kept of each of the BANDS * ROWS minima.
BITS = 2
#: Estimated similarity under which no pair is looked at again: at 0.85 the estimate has a deviation of 0.035.
CUT_OFF = 0.68
#: Words of 64 bits that one bit of all minima takes.
LANES = -(-BANDS * ROWS // 64)
_RNG = np.random.default_rng(85)
SALT, FACTOR = (_RNG.integers(0, 2**63, (BANDS * ROWS, 1)).astype(np.uint64) for _ in range(2))
FACTOR = FACTOR * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """Least value of a set of digests, at least one, under each of the BANDS * ROWS hashes."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[None, at : at + 1024] ^ SALT) * FACTOR).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The lowest BITS bits of the minima, bit by bit: lane k of word w of plane b is bit b of minimum 64 w + k."""
    # high bits choose the minimum, so the low ones are mixed first: equal minima stay equal
    low = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    planes = np.zeros((BITS, LANES * 64), np.uint8)
    for b in range(BITS):
        planes[b, : len(low)] = (low >> np.uint64(b)) & np.uint64(1)
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from signatures: the share of equal b-bit values, corrected for those that collide by chance."""
    differ = np.zeros((len(b), LANES), np.uint64)
    for k in range(BITS):
        differ = differ | (a[:, k * LANES : (k + 1) * LANES] ^ b[:, k * LANES : (k + 1) * LANES])
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / (BANDS * ROWS)
    by_chance = 2.0**-BITS
    return (equal - by_chance) / (1 - by_chance)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, sid, n, signature, bands) of every row: sid is a digest of its set, n its size; texts without words
    have n = 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sid, n, signs, keys = [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, SHINGLE)
                least = minima(h) if len(h) else None
                sid.append(xxhash.xxh64_intdigest(h.tobytes()))
                n.append(len(h))
                signs.append(signature(least) if len(h) else b"")
                keys.append([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))] if len(h) else [])
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.array([x for k in keys for x in k], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_key"), b.column("doc_id"), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(signs, pa.binary()), flat],
                ["doc_key", "doc_id", "sid", "n", "signature", "bands"],
            )

    d = docs.select(F.unhex(doc_key()).alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_key binary, doc_id long, sid long, n long, signature binary, bands array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Rows with equal sets are linked and compared once. Null texts and texts without words have size 0 and are their own
    component. A null doc_id is returned with the smallest doc_id that it reaches, null if there is none. Repeated rows
    are returned as often as given. Other columns take no part. No rows: none.
    """
    m = stored(marked(docs), "minima")
    first = m.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_key", "n", "signature", "bands")).alias("one"))
    each = stored(first.select("sid", "least", "one.*"), "sets")
    rows = docs.select(F.unhex(doc_key()).alias("key"), F.col("text").cast("string").alias("text"))

    def texts(wanted: DataFrame) -> DataFrame:
        w = wanted.join(each.select("sid", "doc_key"), "sid")
        return rows.join(w, F.col("key") == F.col("doc_key")).select("sid", "text")

    roots = resolve(each.select("sid", "n", "signature", "bands"), texts, lambda t: shingles(t, SHINGLE), estimate, CUT_OFF, (NUM, DEN))
    own = each.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("sid").alias("s"), "component_id")
    out = m.select("doc_id", "n", "sid").join(named, F.col("sid") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component, and whether it is the one of its component that is kept."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP12_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as words from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as shingle from w),
n as materialized (select w.doc_id, count(shingle)::bigint as n from w left join s using (doc_id) group by 1),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (
  select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, other) as (
  select doc_id, doc_id from w union select r.doc_id, l.v from reach r join links l on l.u = r.other)
select n.doc_id, n.n as n_shingles, min(other) as component_id, n.doc_id = min(other) as kept from reach r join n using (doc_id) group by n.doc_id, n.n
"""
