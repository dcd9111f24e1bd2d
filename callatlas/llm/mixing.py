"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, word_count

#: Least number of parts that a size class of a source is sorted in, and the rows that raise it by one.
SUBS, ROWS_A_SUB = 16, 1_000_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the words each source gives to the mix.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; a target stops at
    cap times its source's size and the excess goes to the others by weight. In order of size over weight the capped
    sources come first, so running sums give the level at once. One row a source is all that meets in one task.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.select("source", F.col("source_size").cast("long"), pick.alias("w"))
    full = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    s = s.select(
        "*",
        F.sum("source_size").over(full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        F.coalesce(F.sum(cap * F.col("source_size")).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
    )
    free = (F.col("total") - F.col("capped")) * F.col("w") <= cap * F.col("source_size") * F.col("rest")
    level = F.first(F.when(free, (F.col("total") - F.col("capped")) / F.col("rest")), ignorenulls=True).over(full.rowsBetween(W.unboundedPreceding, 0))
    return s.select("source", "source_size", F.coalesce(level * F.col("w"), (cap * F.col("source_size")).cast("double")).alias("target"))


def _order():
    return F.coalesce(F.col("doc_id").cast("long"), F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies, the times that the mix emits the document.

    A document is expected target / source_size times. Within a source the documents are laid out by size, expected
    copies are prefix-summed, one random offset per source is added and a copy is emitted for each integer crossed; the
    order by size makes the words taken come near the target. A source's prefix sums are taken in buckets (size class,
    doc_id modulo a number that grows with the rows) and the buckets' totals are summed over again, so that a hot source
    is spread over tasks.

    Null text: size 0. Null source: a source of its own, last in order. Null doc_id: a digest of the text stands for it in
    the order. Texts of one doc_id and size go by digest; equal rows are told apart only by their place; the set emitted is the same in each run. No rows: none.
    Other columns are carried along, whatever their names; the four columns named above are replaced.
    """
    return _mixed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_count(F.col("text")).alias("size"), _order().alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")), weights, cap, seed).select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in OWN], *OWN)


#: Columns that mix() adds.
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _mixed(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """rows (source, size, key and others) with the columns OWN; rows of one size and key go in order of column tie, if there is one."""
    order = ["size", "key", *(c for c in ("tie",) if c in rows.columns)]
    level = F.length(F.bin(F.col("size"))) * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7")
    subs = max(SUBS, rows.count() // ROWS_A_SUB)
    d = rows.withColumns({"level": level.cast("int"), "sub": F.pmod("key", F.lit(subs)).cast("int")})
    keys = ["source", "level", "sub"]
    buckets = cut(d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    before = F.sum("n").over(W.partitionBy("source").orderBy("level", "sub").rowsBetween(W.unboundedPreceding, -1))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / 1048576
    base = buckets.withColumn("b", F.coalesce(before, F.lit(0))).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = base.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("b").alias("before"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), rate.alias("rate"), offset.alias("offset"))
    ranked = d.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    on = ranked["source"].eqNullSafe(base["b_source"]) & (ranked["level"] == base["b_level"]) & (ranked["sub"] == base["b_sub"])
    place = F.col("before") + F.col("n")
    crossed = F.floor(F.col("offset") + F.col("rate") * place) - F.floor(F.col("offset") + F.col("rate") * (place - 1))
    return ranked.join(base, on).withColumns({"mix_size": F.col("size"), "mix_copies": F.least(crossed, F.lit(cap)).cast("int")})


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken, without the columns that mix() adds."""
    keep = [F.col(f"`{c}`") for c in mixed.columns if c not in OWN]
    copies = mixed.where("mix_copies > 0").select(F.struct(*keep).alias("row"), F.explode(F.expr("sequence(1, mix_copies)")))
    return copies.select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Texts are read once, for their sizes."""
    rows = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), _order().alias("key")))
    m = _mixed(rows)
    return m.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).cast("long").alias("taken"))


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::bigint) as key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
l as (
  select *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) as lev,
    key % greatest(16, (select count(*) from d) // 1000000) as sub from d),
r as (
  select *, row_number() over (partition by source order by lev, sub, size, key) as n from l),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, 1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 as w from s0),
s2 as (
  select *, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by source_size / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(w) over (order by source_size / w, encode(source) nulls last rows between current row and unbounded following) as rest
  from s1),
s3 as (
  select *, case when (total - capped) * w <= 3 * source_size * rest then (total - capped)::double / rest::double end as lev from s2),
s4 as (
  select source, source_size, coalesce(first_value(lev ignore nulls) over (order by source_size / w, encode(source) nulls last rows between unbounded preceding and current row) * w, 3.0 * source_size)::double as target from s3),
s5 as (
  select *, case when source_size > 0 then target / source_size::double else 0 end as rate,
    ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 5))::bigint::double / 1048576 as u from s4)
select doc_id, size, r_source_size as source_size, target,
  (size * least((floor(u + rate * n) - floor(u + rate * (n - 1)))::bigint, 3))::bigint as taken
from (select r.doc_id, r.size, s5.source_size as r_source_size, target, rate, u, n from r join s5 on r.source is not distinct from s5.source)
"""
