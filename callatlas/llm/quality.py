"""Quality rules: statistics of whole texts and an isolation forest over them, with a threshold from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, split_words, table

#: Rows that the forest is grown from, at most: a sample by hash of doc_id. Each tree takes SUBSAMPLE of them.
SAMPLE, SUBSAMPLE, TREES = 8192, 256, 64
BINS = 4096


def repeated(words: pa.Array, rows: np.ndarray, n_rows: int, width: int = 5) -> np.ndarray:
    """Per row, the words that lie in a window of width words found twice or more in the row, the first one included.

    Windows are ranked by doubling: pairs of words, then pairs of pairs, each within its row, so equal ranks mean equal
    windows without any hash.
    """
    out = np.zeros(n_rows, np.int64)
    n = len(words)
    if n <= width:
        return out
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # ranks of windows of 1, 2, 4 words; those that leave the row are cut off at the end
    rank2 = _ranks(ids[:-1], ids[1:])
    rank4 = _ranks(rank2[:-2], rank2[2:])
    m = n - width + 1
    whole = rows[:m] == rows[width - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    window = _ranks(rank4[at], ids[at + 4]) if width == 5 else None
    window = _ranks(window, rows[at])
    twice = np.bincount(window)[window] > 1
    mark = np.zeros(n + 1, np.int64)
    starts = at[twice]
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + width, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(rows[covered], minlength=n_rows).astype(np.int64)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a, b), equal where the pairs are."""
    return pd.factorize(a * np.int64(int(b.max()) + 1 if len(b) else 1) + b)[0].astype(np.int64)


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; null: all zero."""
    n = len(text)
    text = pc.fill_null(text, "")
    words, rows = split_words(text)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(text, "\n")
    lines, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    key = pd.DataFrame({"r": of[full], "l": lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)[full]})
    again = key.duplicated().to_numpy()
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": np.bincount(rows, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": np.bincount(key["r"].to_numpy()[again], minlength=n).astype(np.int64),
        "n_repeat_words": repeated(words, rows, n),
    }


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(s[k]) for k in STATS]], ["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def features(s) -> np.ndarray:
    """Ratios of the statistics, without a scale of their own: symbols a word, repeated share, duplicate lines, word length."""
    n = np.maximum(np.asarray(s["n_words"], float), 1)
    return np.stack([np.asarray(s["n_symbols"], float) / n, np.asarray(s["n_repeat_words"], float) / n, np.log1p(np.asarray(s["n_dup_lines"], float)), np.asarray(s["word_chars"], float) / n], axis=1)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0) -> dict:
    """An isolation forest: per tree, arrays of split feature, value, children and, at the leaves, path length."""
    rng = np.random.default_rng(seed)
    depth = math.ceil(math.log2(max(2, min(subsample, len(x)))))
    forest = []
    for _ in range(trees):
        nodes: list[list] = []

        def build(part: np.ndarray, at: int, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, at + average(len(part))])
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
            if at >= depth or len(part) < 2 or not (high > low).any():
                return me
            f = int(rng.choice(np.flatnonzero(high > low)))
            v = float(rng.uniform(low[f], high[f]))
            nodes[me][:2] = f, v
            nodes[me][2], nodes[me][3] = build(part[part[:, f] < v], at + 1), build(part[part[:, f] >= v], at + 1)
            return me

        build(x[rng.choice(len(x), min(subsample, len(x)), replace=False)], 0)
        forest.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return {"trees": forest, "scale": average(min(subsample, len(x))) or 1.0}


def average(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def score(forest: dict, x: np.ndarray) -> np.ndarray:
    """Anomaly from 0 to 1: two to the power of minus the mean path length over the expected one."""
    total = np.zeros(len(x))
    for f, v, left, right, path in forest["trees"]:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = f[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            go = x[i, f[at[i]].astype(int)] < v[at[i]]
            at[i] = np.where(go, left[at[i]], right[at[i]])
        total += path[at]
    return 2.0 ** (-total / (len(forest["trees"]) * forest["scale"]))


#: Features that a forest is grown on: each by itself, and all together.
VIEWS = ((0,), (1,), (2,), (3,), (0, 1, 2, 3))


def calibrate(scored: DataFrame, most_lost: float = 0.001) -> list[float]:
    """For each forest the least anomaly at which a document goes: at most most_lost of all good labelled rows reach it. From a
    histogram of all labelled rows over BINS bins; without good rows, nothing goes."""
    each = scored.select("quality", F.posexplode("anomalies").alias("k", "a"))
    bins = each.groupBy("k", F.least(F.floor(F.col("a") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    held: list[dict] = [{} for _ in VIEWS]
    for r in bins.collect():  # BINS rows a forest at most
        held[r["k"]][r["bin"]] = r["good"]
    cuts = []
    for h in held:
        good, lost, at = sum(h.values()), 0, BINS
        while good and at > 0 and lost + h.get(at - 1, 0) <= most_lost * good:
            at -= 1
            lost += h.get(at, 0)
        cuts.append(at / BINS if good else 2.0)
    return cuts


def sample(rows: DataFrame, most: int) -> DataFrame:
    """most rows at most, the first by a hash of doc_id and statistics: a threshold from the number of rows lets about twice as
    many through as are taken, and only these are sorted."""
    h = F.xxhash64("doc_id", *STATS)
    share = min(1.0, (2 * most + 200) / max(1, rows.count()))
    return rows.where(h <= int(-(2**63) + share * (2**64 - 1025))).orderBy(h, "doc_id", *STATS).limit(most)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the other statistics, base_failed, anomalies (one a forest) and kept of every document.

    base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed and all anomalies
    below their thresholds. Base-failed rows take no part in forest and threshold. Null and empty texts have no words and
    fail. Labels of null doc_id or quality count for nothing; several labels of one document count each. Repeated rows
    are judged alike. No rows: none.
    """
    s = cut(with_statistics(docs))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    s = s.withColumn("base_failed", failed)
    part = sample(s.where("not base_failed"), SAMPLE).select(*STATS).toPandas()  # SAMPLE rows at most
    x = features(part)
    forests = [grow(x[:, v], seed=k) for k, v in enumerate(VIEWS)] if len(part) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({k: b.column(k).to_numpy() for k in STATS})
            a = np.stack([score(f, x[:, v]) for f, v in zip(forests, VIEWS, strict=True)], axis=1) if forests else np.zeros((len(x), len(VIEWS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(VIEWS)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "anomalies"])

    scored = s.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, anomalies array<double>")
    marks = labels.where("quality is not null").select(F.col("doc_id").alias("label_id"), "quality")
    cuts = calibrate(scored.where("not base_failed").join(marks, F.col("doc_id") == F.col("label_id")))
    usual = F.forall(F.arrays_zip("anomalies", F.array(*map(F.lit, cuts)).alias("cuts")), lambda z: z["anomalies"] < z["cuts"])
    return scored.withColumn("kept", ~F.col("base_failed") & usual)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict, as judge() gives them."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *STATS, "base_failed", "kept", F.round(F.element_at("anomalies", -1), 9).alias("anomaly"))
