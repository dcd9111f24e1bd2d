"""Exact quantiles of a whole corpus without a sort and without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.held import held


def exact_quantiles(df: DataFrame, value: str, points: tuple[float, ...], by: tuple[str, ...] = (), buckets: int = 4096) -> DataFrame:
    """(by, point, value): the quantiles of column value, interpolated between neighbours as percentile() does.

    For each rank that is wanted the range of values that holds it is cut into buckets, counted before anything is
    shuffled; the bucket with the rank gives the next range, from its least to its greatest value, until both are one. A
    round costs a pass over one narrow column and moves buckets * ranks counts at most. Nulls and NaN take no part; a group without values has no rows.
    """
    v = held(df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    n = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    at = F.col("point") * (F.col("n") - 1)
    ranks = n.withColumn("point", F.explode(F.array(*map(F.lit, points)))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    ranks = ranks.withColumns({"share": at - F.floor(at), "rank": F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)), "below": F.lit(0).cast("long")})
    key, names = [*by, "point", "side"], [*by, "point", "side", "share", "rank", "below", "lo", "hi"]
    ranks = held(ranks.select(*names))
    while (open_ := ranks.where("lo < hi")).limit(1).count():
        o = open_.select(*[F.col(c).alias("o_" + c) for c in names])
        inside = (F.col("v") >= F.col("o_lo")) & (F.col("v") <= F.col("o_hi"))
        same = inside if not by else inside & _all([F.col(b).eqNullSafe(F.col("o_" + b)) for b in by])
        place = F.least(F.lit(buckets - 1), F.floor((F.col("v") / 2 - F.col("o_lo") / 2) / (F.col("o_hi") / 2 - F.col("o_lo") / 2) * buckets))
        h = v.join(o, same).groupBy(*["o_" + c for c in names], place.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        before = F.sum("n").over(W.partitionBy(*["o_" + c for c in key]).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        h = h.withColumn("before", F.col("o_below") + F.coalesce(before, F.lit(0))).where("o_rank >= before and o_rank < before + n")
        found = h.select(*[F.col("o_" + c).alias(c) for c in names[:-3]], F.col("before").alias("below"), F.col("a").alias("lo"), F.col("z").alias("hi"))
        ranks = held(ranks.where("lo >= hi").unionByName(found))
    value_at = lambda s: F.max(F.when(F.col("side") == s, F.col("lo")))
    return ranks.groupBy(*by, "point").agg((value_at(0) + F.max("share") * (value_at(1) - value_at(0))).alias("value"))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
