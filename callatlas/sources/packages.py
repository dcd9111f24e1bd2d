"""Packages of articles that are published in two phases, so that a run that fails leaves what was published before whole.

A store is a folder of three tables, cut by run: files (call_id, path, content), manifest (a row a call: how many files, how many
bytes, a digest) and commits (a row a run). A run writes files, then its manifest, then, when both are whole, one commit in one
file. Readers take each call from its last committed run, so files without a commit are never seen. Runs are ordered by their
names, such as the time they began. Only Spark reads and writes, so a store can lie wherever Spark's tables can.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "calls long, files long, bytes long, run string"


def publish(pages: DataFrame, store: str, run: str) -> None:
    """Writes the packages of pages (call_id, path, content) as a run of store. A call that is published again has the files of
    the last run only; a run without a commit can be written again under its name, one with a commit can't. A null call_id
    or path has no place in a package and is an error, as is a path that a call has twice."""
    spark = pages.sparkSession
    if committed(spark, store).where(F.col("run") == run).count():
        raise ValueError(f"run {run} is committed")
    prepare(pages, store, run)
    commit(spark, store, run)


def prepare(pages: DataFrame, store: str, run: str) -> None:
    """The first phase: files and their manifest, not seen by readers yet."""
    known = F.col("call_id").isNotNull() & F.col("path").isNotNull()
    p = pages.select(F.when(known, F.col("call_id")).otherwise(F.raise_error("a file has no call_id or path")).alias("call_id"), "path", "content")
    p.repartition("call_id").sortWithinPartitions("call_id", "path").write.mode("overwrite").parquet(f"{store}/files/run={run}")
    written = pages.sparkSession.read.parquet(f"{store}/files/run={run}")
    m = summary(written)
    m = m.withColumn("files", F.when(F.col("files") == F.col("paths"), F.col("files")).otherwise(F.raise_error(F.concat(F.lit("a path is there twice in call "), F.col("call_id").cast("string")))))
    m.drop("paths").write.mode("overwrite").parquet(f"{store}/manifest/run={run}")


def commit(spark: SparkSession, store: str, run: str) -> None:
    """The second phase: one row in one file, made from the manifest as it was written."""
    m = spark.read.parquet(f"{store}/manifest/run={run}")
    total = m.agg(F.count("*").alias("calls"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/run={run}")


def summary(files: DataFrame) -> DataFrame:
    """A row a call: files, different paths, bytes, and a digest that does not depend on the order of files."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    by = [c for c in ("run", "call_id") if c in files.columns]
    each = files.select(*by, "path", size.alias("size"), F.xxhash64("path", F.sha2(F.coalesce("content", F.lit(b"")), 256)).alias("h"))
    return each.groupBy(*by).agg(F.count("*").alias("files"), F.countDistinct("path").alias("paths"), F.sum("size").alias("bytes"), F.bit_xor("h").alias("digest"))


def committed(spark: SparkSession, store: str) -> DataFrame:
    """The commits of a store: calls, files, bytes, run. A store that is not there yet has none."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def current(spark: SparkSession, store: str, key: str = "long") -> DataFrame:
    """(call_id, run, files, bytes, digest): the run that serves each call. key is the type of call_id."""
    m = spark.read.schema(f"call_id {key}, files long, bytes long, digest long, run string").parquet(f"{store}/manifest")
    m = m.join(committed(spark, store).select("run"), "run", "left_semi")
    return m.groupBy("call_id").agg(F.max_by(F.struct("run", "files", "bytes", "digest"), "run").alias("m")).select("call_id", "m.*")


def files(spark: SparkSession, store: str, key: str = "long") -> DataFrame:
    """(call_id, path, content, run) of the packages as published last."""
    every = spark.read.schema(f"call_id {key}, path string, content binary, run string").parquet(f"{store}/files")
    return every.join(current(spark, store, key).select("run", "call_id"), ["run", "call_id"]).select("call_id", "path", "content", "run")


def damaged(spark: SparkSession, store: str, key: str = "long") -> DataFrame:
    """(call_id, run): published calls whose files are not those of their manifest, such as after a lost or changed file."""
    there = summary(files(spark, store, key)).select("run", "call_id", F.col("files").alias("n"), F.col("digest").alias("d"))
    j = current(spark, store, key).join(there, ["run", "call_id"], "left")
    return j.where(~(F.col("files").eqNullSafe(F.col("n")) & F.col("digest").eqNullSafe(F.col("d")))).select("call_id", "run")


def superseded(spark: SparkSession, store: str, key: str = "long") -> DataFrame:
    """Committed runs that serve no call any more and may be removed: (run)."""
    return committed(spark, store).select("run").join(current(spark, store, key).select("run").distinct(), "run", "left_anti")
