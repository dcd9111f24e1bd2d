"""Texts of a call that read alike: a similarity join on their rarest pairs of letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity

#: Letters of a shorter text than this may differ so much that no pair of letters need be shared.
SHORT = 6


def alike_texts(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(call_id, a, b): each text a of left (call_id, text) with each text b of right that it reads like by least or more.

    Two texts with at most k edits, the longer of m letters, share m - 1 - 2k pairs of letters at least. With its pairs in
    order of how rare they are, a text keeps as many as must hold one of the shared ones, and only texts that keep a common
    pair, and whose lengths allow it, are compared. Texts under SHORT letters share a key with all of up to SHORT / least letters. Null texts read like none.
    """
    def texts(d: DataFrame) -> DataFrame:
        return d.where("text is not null").select("call_id", "text").distinct()

    a, b = texts(left), texts(right)
    every = a.select("text").union(b.select("text")).distinct().withColumn("s", F.lower(F.trim("text"))).withColumn("size", F.length("s"))
    grams = F.expr("transform(sequence(1, size - 1), i -> substring(s, i, 2))")
    numbered = F.expr("transform(g, (x, i) -> concat(x, size(filter(slice(g, 1, i), y -> y = x))))")
    each = every.where(F.col("size") >= SHORT).withColumn("g", grams).select("text", "size", F.explode(numbered).alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("held"))
    most = int(1 / least * 1000) / 1000
    shared = F.expr(f"array_min(transform(sequence(size, cast(floor(size * {most}) as int) + 1), m -> m - 1 - 2 * cast(floor(m * {1 - least} + 1e-9) as int)))")
    place = F.row_number().over(W.partitionBy("text").orderBy("held", "gram"))
    kept = each.join(rare, "gram").withColumn("k", place).where(F.col("k") <= F.col("size") - 1 - F.greatest(shared, F.lit(1)) + 1).select("text", "size", "gram")
    kept = kept.union(every.where(F.col("size") <= SHORT / least).select("text", "size", F.lit("").alias("gram")))  # a short text's key
    side = lambda d, n: d.join(kept, "text").select("call_id", "gram", F.col("text").alias(n), F.col("size").alias(n + "_size"))
    met = side(a, "a").join(side(b, "b"), ["call_id", "gram"])
    fits = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-9
    return met.where(fits).select("call_id", "a", "b").distinct().where(similarity(F.col("a"), F.col("b")) >= least)
