"""Packages published in two phases."""

import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from callatlas.sources import packages as P

PAGES = "call_id long, path string, content binary"


def seen(spark, store):
    return {(r["call_id"], r["path"], bytes(r["content"]), r["run"]) for r in P.files(spark, store).collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = str(tmp_path / "store")
    P.publish(spark.createDataFrame([(1, "a/article.md", b"one"), (1, "a/images/step-01.jpg", b"\xff"), (2, "b/article.md", b"two")], PAGES), s, "r1")
    return s


FIRST = {(1, "a/article.md", b"one", "r1"), (1, "a/images/step-01.jpg", b"\xff", "r1"), (2, "b/article.md", b"two", "r1")}


def test_a_later_run_replaces_its_own_calls_whole(spark, store):
    assert seen(spark, store) == FIRST
    P.publish(spark.createDataFrame([(1, "a/article.md", b"new")], PAGES), store, "r2")  # the image is gone with its run
    assert seen(spark, store) == {(1, "a/article.md", b"new", "r2"), (2, "b/article.md", b"two", "r1")}
    assert [r["run"] for r in P.superseded(spark, store).collect()] == []
    P.publish(spark.createDataFrame([(1, "a/article.md", b"newer")], PAGES), store, "r3")
    assert [r["run"] for r in P.superseded(spark, store).collect()] == ["r2"]
    assert [(r["calls"], r["files"], r["bytes"]) for r in P.committed(spark, store).orderBy("run").collect()] == [(2, 3, 7), (1, 1, 3), (1, 1, 5)]


def test_a_write_that_dies_is_not_seen_and_can_be_repeated(spark, store):
    dies = spark.range(3).select((F.col("id") + 1).alias("call_id"), F.lit("x.md").alias("path"), F.when(F.col("id") < 2, F.encode(F.lit("half"), "UTF-8")).otherwise(F.raise_error("killed").cast("binary")).alias("content"))
    with pytest.raises(PySparkException):
        P.publish(dies, store, "r2")
    assert seen(spark, store) == FIRST
    P.prepare(dies.where("call_id < 3"), store, "r2")  # all but the commit
    assert seen(spark, store) == FIRST and P.damaged(spark, store).count() == 0
    P.publish(dies.where("call_id < 2"), store, "r2")
    assert seen(spark, store) == {(1, "x.md", b"half", "r2"), (2, "b/article.md", b"two", "r1")}
    with pytest.raises(ValueError):
        P.publish(dies.where("call_id < 2"), store, "r2")


def test_a_lost_file_is_told(spark, store):
    P.publish(spark.createDataFrame([(3, "c/article.md", b"three")], PAGES), store, "r2")
    assert P.damaged(spark, store).count() == 0
    for f in pathlib.Path(store, "files", "run=r2").glob("*.parquet"):
        f.unlink()
    spark.catalog.clearCache()
    assert [tuple(r) for r in P.damaged(spark, store).collect()] == [(3, "r2")]


@pytest.mark.parametrize("row", [(None, "a.md", b""), (1, None, b"")])
def test_files_without_a_place_are_an_error(spark, tmp_path, row):
    with pytest.raises(PySparkException):
        P.publish(spark.createDataFrame([row], PAGES), str(tmp_path / "s"), "r1")


def test_a_path_twice_is_an_error_and_empty_runs_are_not(spark, tmp_path):
    s = str(tmp_path / "s")
    with pytest.raises(PySparkException):
        P.publish(spark.createDataFrame([(1, "a.md", b"1"), (1, "a.md", b"2")], PAGES), s, "r1")
    P.publish(spark.createDataFrame([], PAGES), s, "r2")
    P.publish(spark.createDataFrame([(1, "a.md", None), (1, "b.md", b"")], PAGES), s, "r3")
    assert [(r["call_id"], r["path"], r["content"], r["run"]) for r in P.files(spark, s).orderBy("path").collect()] == [(1, "a.md", None, "r3"), (1, "b.md", b"", "r3")]
    assert P.damaged(spark, s).count() == 0


def test_names_of_calls_may_be_text(spark, tmp_path):
    s = str(tmp_path / "s")
    P.publish(spark.createDataFrame([("call-a", "a.md", b"1")], "call_id string, path string, content binary"), s, "2024-01-01")
    assert [tuple(r) for r in P.current(spark, s, "string").select("call_id", "run").collect()] == [("call-a", "2024-01-01")]
