"""Ranked lexical search over a length-stratified index: documents of equal normaliser together, postings by term frequency."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, stored, table

#: Bytes that part terms become spaces, A-Z become a-z; all bytes of other characters belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: The integer normaliser of a document is LOW + ((HIGH * n * N) div L).
LOW, HIGH = 10, 90
#: Terms of the queries of one block, and postings of one shard of the index.
BLOCK_TERMS, SHARD = 500_000, 4_000_000


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; null: none."""
    return (text or "").encode("utf-8").translate(_TERMS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: n counts all of them, the lists hold those of vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in pieces(batches, "text"):
            sizes, held = [], []
            for text in b.column("text").to_pylist():
                t = terms(text)
                sizes.append(len(t))
                c = Counter(map(get, t))
                c.pop(None, None)
                held.append(c)
            ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array([x for c in held for x in f(c)], pa.int32())) for f in (Counter.keys, Counter.values)]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([x > 0 for x in sizes], pa.bool_()))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents, sorted by (term, m, tf): a run of equal (term, m) is a stratum's list, a run of equal
    (term, m, tf) within it shares one impact."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, at: np.ndarray, weight: np.ndarray):
        """doc and m: a document each; term, tf and at (place of the document): a posting each."""
        order = np.lexsort((at, tf, m[at], term))
        term, tf, self.at = term[order], tf[order], at[order]
        strata = m[self.at]
        self.doc, self.strata = doc, np.unique(m)
        new = lambda *cols: np.flatnonzero(np.concatenate(([len(term) > 0], np.any([c[1:] != c[:-1] for c in cols], axis=0)))[: len(term)])
        same = new(term, strata, tf)
        impact = weight[term[same]] * ((1_000_000_000 * tf[same]) // (1000 * tf[same] + 8 * strata[same]))  # once per tf
        self.impact = np.repeat(impact, np.diff(np.append(same, len(term))))
        self.start = new(term, strata)
        self.stop = np.append(self.start[1:], len(term))[: len(self.start)]
        self.most = self.impact[self.stop - 1]  # tf rises within a list, and impact with it
        self.term = term[self.start]
        self.stratum = np.searchsorted(self.strata, strata[self.start])

    def search(self, query: np.ndarray, k: int, least: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(scores, doc_ids) of the k best documents of at least least, and above 0, for the sorted term numbers of query.

        Strata are visited by falling bound, the sum of their lists' highest impacts; the rest is left once the next bound is under the kth score.
        """
        a, z = np.searchsorted(self.term, query, "left"), np.searchsorted(self.term, query, "right")
        lists = _ranges(a, z)
        bound = np.zeros(len(self.strata), np.int64)
        np.add.at(bound, self.stratum[lists], self.most[lists])
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = lists[np.argsort(place[self.stratum[lists]], kind="stable")]
        turn = place[self.stratum[lists]]  # in which place the stratum of a list is visited
        sizes = np.cumsum(self.stop[lists] - self.start[lists])
        score, who, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while done < len(lists):
            if bound[order[turn[done]]] < max(least, 1):
                break
            last = min(int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + step)), len(lists) - 1)
            end = int(np.searchsorted(turn, turn[last], "right"))  # whole strata
            at = _ranges(self.start[lists[done:end]], self.stop[lists[done:end]])
            docs, of = np.unique(self.at[at], return_inverse=True)
            sums = np.zeros(len(docs), np.int64)
            np.add.at(sums, of, self.impact[at])
            score, who = best(np.concatenate((score, sums)), np.concatenate((who, self.doc[docs])), k, max(least, 1))
            least = max(least, int(score[-1]) if len(score) == k else 0)
            done, step = end, step * 2
        return score, who


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its stop."""
    n = stop - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def best(score: np.ndarray, doc: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of at least least, ties by ascending doc."""
    ok = np.flatnonzero(score >= least)
    if len(ok) > 4 * k:
        kth = np.partition(score[ok], len(ok) - k)[len(ok) - k]
        ok = ok[score[ok] >= kth]
    ok = ok[np.lexsort((doc[ok], -score[ok]))][:k]
    return score[ok], doc[ok]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs (doc_id, text) for each query (item_id, text).

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))); a score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over a
    query's distinct terms, m = 10 + ((90 n N) div L). Documents are ranged by m and, within it, by a hash, so that a hot
    length is many tasks; a task cuts them into shards of a bounded number of postings and carries each query's kth
    score from shard to shard. Only terms of queries are indexed. Queries go in blocks of block_terms terms, so the
    driver and the tasks hold one block's terms and never more.

    Null, empty and termless texts are not found and are not counted in N; a query without terms has no rows. Null
    doc_ids rank after others of their score; repeated rows take a rank each, equal item_ids are queries of their own only if their
    texts differ. Other columns take no part. No rows: none.
    """
    spark = docs.sparkSession
    q = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = q.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_terms)))  # four characters a term at least, or fewer distinct ones
    out = None
    for block in range(blocks):
        part = q.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else q
        found = _block(docs, [(r["item_id"], sorted(set(terms(r["text"])))) for r in part.collect()], k, shard)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], k: int, shard: int) -> DataFrame:
    """search() for the given items and their distinct terms."""
    names = sorted({t for _, ts in queries for t in ts})
    vocabulary = {t: i for i, t in enumerate(names)}
    index = stored(postings(docs, vocabulary), "postings")
    docs_n, terms_n = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((weight, [(i, np.array([vocabulary[t] for t in ts], np.int64)) for i, ts in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, items = held.value
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        rows: list[pa.RecordBatch] = []
        size = 0

        def visit() -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            lists = t.column("terms").combine_chunks()
            at = lists.value_parent_indices().to_numpy().astype(np.int64)
            flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
            s = Shard(t.column("place").to_numpy(), t.column("m").to_numpy(), flat("terms"), flat("tfs"), at, w)
            for x, (_, query) in enumerate(items):
                score, doc = tops[x]
                more = s.search(query, k, int(score[-1]) if len(score) == k else 0)
                tops[x] = best(np.concatenate((score, more[0])), np.concatenate((doc, more[1])), k, 1)
            rows.clear()

        for b in batches:
            rows.append(b)
            size += len(b.column("terms").flatten()) + b.num_rows
            if size >= shard:
                visit()
                size = 0
        if rows:
            visit()
        flat = [(i, x, d, s) for x, ((i, _), (score, doc)) in enumerate(zip(items, tops, strict=True)) for s, d in zip(score.tolist(), doc.tolist(), strict=True)]
        cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "query", "place", "score"])

    # a null doc_id comes last among equals
    m = F.lit(LOW) + F.expr(f"({HIGH} * n * {docs_n}L) div {max(terms_n, 1)}L")
    d = index.where(F.size("terms") > 0).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), m.alias("m"), "terms", "tfs")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = d.repartitionByRange(parts, "m", F.xxhash64("place", "terms")).mapInArrow(run, "item_id long, query int, place long, score long".replace("query int", "query long"))
    rank = F.row_number().over(W.partitionBy("item_id", "query").orderBy(F.desc("score"), "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.when(F.col("place") < 2**63 - 1, F.col("place")).alias("doc_id"), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with low as (
  select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (
  select doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from low),
d as (select doc_id, count(*)::bigint as n from t group by 1),
a as (select count(*)::bigint as docs, sum(n)::bigint as len from d),
p as (select doc_id, term, count(*)::bigint as tf from t group by 1, 2),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, a group by term, docs),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))))::bigint as score
  from q join w using (term) join p using (term) join d using (doc_id), a group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
