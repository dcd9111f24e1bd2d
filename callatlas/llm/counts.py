"""Token counts: an exact histogram of encoded lengths, and its suffix sums for every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pieces, table

TOKENIZERS = "/opt/tokenizers"
#: The pretokenizer's pattern of the public 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """A byte-level encoder from a file of base64 pieces and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of the pattern, in runs so long that its look-ahead would run out of stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def count(coder, text: str | None) -> int:
    """Tokens of a text; null: 0. A long run of white space is one pretoken but for its last character, which begins the
    next one unless the text ends there; it goes to the merge table by itself, and what stands on both sides apart."""
    n, at = 0, 0
    for m in LONG_SPACE.finditer(text or ""):
        stop = m.end() - (m.end() < len(text))
        n += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : stop]))
        at = stop
    return n + len(coder.encode_ordinary(text[at:])) if text else 0


def lengths(docs: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(source, n_tokens): the encoded length of each text; null texts have length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in pieces(batches, "text"):
            n = np.array([count(coder, t) for t in b.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array(n)], ["source", "n_tokens"])

    return docs.select("source", "text").mapInArrow(run, "source string, n_tokens long")


def histogram(lengths_: DataFrame) -> DataFrame:
    """(source, n_tokens, docs); counted before it is shuffled, so a hot source is no hot key."""
    return lengths_.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, shift: int = 10) -> DataFrame:
    """hist with docs_ge and tokens_ge, the sums over this length and longer ones, and of each source the docs and tokens.

    The lengths of a source are summed in ranges of 2**shift, the ranges' totals are summed in turn and joined back, so
    that a source with many lengths is spread over tasks.
    """
    h = hist.withColumns({"hi": F.shiftright("n_tokens", shift), "tokens": F.col("docs") * F.col("n_tokens")})
    after = W.partitionBy("source").orderBy(F.col("hi").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    r = h.groupBy("source", "hi").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = r.select(F.col("source").alias("s"), F.col("hi").alias("h"), zero(F.sum("d").over(after)).alias("d0"), zero(F.sum("t").over(after)).alias("t0"), F.sum("d").over(whole).alias("source_docs"), F.sum("t").over(whole).alias("source_tokens"))
    own = W.partitionBy("source", "hi").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumns({"d1": F.sum("docs").over(own), "t1": F.sum("tokens").over(own)})
    j = h.join(r, h["source"].eqNullSafe(r["s"]) & (h["hi"] == r["h"]))
    return j.select("source", "n_tokens", "docs", (F.col("d0") + F.col("d1")).alias("docs_ge"), (F.col("t0") + F.col("t1")).alias("tokens_ge"), "source_docs", "source_tokens")


def answers(sums: DataFrame) -> DataFrame:
    """For each source and each length L it holds, as a context limit: docs of length L, docs as long or longer, all tokens,
    the tokens kept when every document is cut to L, and the share of documents of length L at most."""
    kept = F.col("source_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")
    below = (F.col("source_docs") - F.col("docs_ge") + F.col("docs")) / F.col("source_docs")
    return sums.select("source", F.col("n_tokens").alias("limit"), "docs", "docs_ge", "source_docs", "source_tokens", kept.alias("tokens_truncated"), below.alias("quantile"))


def quantiles(sums: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(source, point, n_tokens): the least length with at least that share of the source's documents at or below it."""
    a = answers(sums).withColumn("point", F.explode(F.array(*map(F.lit, points)))).where("quantile >= point")
    return a.groupBy("source", "point").agg(F.min("limit").alias("n_tokens"))


def truncated_totals(sums: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """(source, limit, tokens): the tokens kept of each source when every document is cut to limit, for any limits."""
    a = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    first = F.min(F.when(F.col("n_tokens") >= F.col("limit"), F.struct("n_tokens", "docs_ge", "tokens_ge")))
    g = a.groupBy("source", "limit").agg(first.alias("f"), F.first("source_tokens").alias("n"))
    return g.select("source", "limit", F.when(F.col("f").isNull(), F.col("n")).otherwise(F.col("n") - F.col("f.tokens_ge") + F.col("f.docs_ge") * F.col("limit")).alias("tokens"))


#: Context limits and shares of documents that the query answers beside every length.
LIMITS, POINTS = (128, 512, 2048, 8192, 32768), (0.25, 0.5, 0.9, 0.99)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every source, null source apart, by kind: length, every length that it holds as a limit; context, the
    tokens kept at each of LIMITS; quantile, the least length for each of POINTS. Null texts have length 0; no rows: none."""
    sums = suffix_sums(cut(histogram(lengths(table(spark, sf_dir, "documents")))))
    each = answers(sums).select(F.lit("length").alias("kind"), "*")
    context = truncated_totals(sums, LIMITS).select(F.lit("context").alias("kind"), "source", "limit", F.col("tokens").alias("tokens_truncated"))
    shares = quantiles(sums, POINTS).select(F.lit("quantile").alias("kind"), "source", F.col("n_tokens").alias("limit"), F.col("point").alias("quantile"))
    return each.unionByName(context, allowMissingColumns=True).unionByName(shares, allowMissingColumns=True)
