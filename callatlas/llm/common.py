"""Helpers shared by the training-data operators: tables, shared folders, Arrow pieces, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.callatlas.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.callatlas.shared.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and read it back from the shared folder, so that lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a table of its own in the shared folder, of which readers take the columns that they need."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reduced(big: DataFrame, key, few: DataFrame, few_key, buckets: int = 1 << 18, how: str = "left_semi") -> DataFrame:
    """The rows of big whose key can be among those of few: all that are, and others by chance. The hash buckets of few are
    sent to all tasks, a number each and buckets numbers at most; an exact join follows and shuffles less. how left_anti
    gives the rows that are left, none of which is among few."""
    bucket = lambda c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    held = few.select(bucket(few_key).alias("bucket_of_few")).distinct()
    return big.join(F.broadcast(held), bucket(key) == F.col("bucket_of_few"), how)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about most_bytes at most; a row is never divided."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they are. What Arrow has freed goes back to the system after each, as workers stay and would add up."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


def split_words(text: pa.Array):
    """(words, rows): every word of the texts in order, and the row that it is in. Null texts have none."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    rows = pc.list_parent_indices(lists)
    words = pc.list_flatten(lists)
    full = pc.not_equal(words, "")
    return words.filter(full), rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, "np.ndarray"]]:
    """(table, starts): the rows of batches sorted by keys, about rows at a time, and where each group of equal keys starts.
    A group is never divided, so a worker holds about rows plus the largest group."""
    import numpy as np

    def starts(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0))))

    held: list[pa.RecordBatch] = []
    size, wanted = 0, rows
    for b in batches:
        held, size = [*held, b], size + b.num_rows
        if size < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, int(s[-1])), s[:-1]
            t = t.slice(int(s[-1]))
        held, size = t.to_batches(), t.num_rows
        wanted = max(rows, 2 * size)
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def word_count(text) -> "F.Column":
    """Number of words of a text column, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of undirected edges (u, v), both long; root is the smallest node of its component.

    Alternates large-star and small-star steps. A step takes each node's least neighbour by a partial aggregate and joins
    it back, so that a hub is split by the skew join; nothing is gathered per node. Every round is written to the shared
    folder; only the number of edges and a checksum come to the driver, to see whether the round changed anything.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("a", "b")
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("b0")).select(F.col("a"), F.least("a", "b0").alias("m"))
        out = near.join(least, "a")
        if large:
            return out.where("b > a and b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        return out.where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.where("a <> m").select(F.col("a"), F.col("m")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    was = mark(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        now = cut(star(star(now, True).distinct(), False).distinct())
        if (new := mark(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
