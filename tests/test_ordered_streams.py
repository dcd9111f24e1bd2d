"""Streams whose batches come in any order give what the batch rules give; silent calls leave nothing behind."""

import random

import pytest
from pyspark.sql import functions as F

from callatlas.operators import clicks, targets
from callatlas.streaming import ordered as O

END = 10**9  # seconds: a row of another call that takes the watermark past all others


def fed(spark, path, rows, schema, parts=4):
    """A stream of the rows, shuffled over several batches, then one row that ends all."""
    r = random.Random(3)
    rows = list(rows)
    r.shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(f"{path}/{k}")
    last = [(-1, float(END), *[None] * (len(rows[0]) - 2))]
    for k in range(2):  # the second lets the timers of the first run
        spark.createDataFrame(last, schema).coalesce(1).write.parquet(f"{path}/{parts + k}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return s.withColumn("ts", F.timestamp_micros((F.col("time_s") * 1_000_000).cast("long")))


def run(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.schema(stream.schema).parquet(f"{path}-out").where("call_id >= 0"), left


@pytest.fixture
def spark_rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_state_changes_in_any_order(spark_rocks, tmp_path):
    spark, r = spark_rocks, random.Random(1)
    rows = [(c, 1 + k * 0.25, r.choice((0.0, 0.001, 0.002, 0.01, 0.3))) for c in range(4) for k in range(50)]
    schema = "call_id long, time_s double, fraction double"
    got, left = run(spark, O.state_changes(fed(spark, f"{tmp_path}/a", rows, schema), "1000 days", 60_000), f"{tmp_path}/a")
    want = clicks.state_changes(spark.createDataFrame(rows, schema), ["time_s"]).select("call_id", "time_s", "fraction", "confidence")
    a, b = ({tuple(r) for r in x.collect()} for x in (got, want))
    assert (a - b, b - a) == (set(), set()) and got.count() == len(b)
    assert left <= 4  # only the row that ends all still waits


def test_elements_in_any_order(spark_rocks, tmp_path):
    spark, r = spark_rocks, random.Random(2)
    rows = []
    for c in range(3):
        for k in range(30):
            x, y, t = 100 * r.randrange(6) + r.randrange(3), 50 * r.randrange(4), r.choice(("Save", "Open", None))
            rows.append((c, 1 + k * 0.5, k, x, y, x + 80, y + 30, t, 0.9, 0.5, "button"))
    schema = "call_id long, time_s double, det_seq long, x1 int, y1 int, x2 int, y2 int, text string, text_confidence double, interactive_confidence double, class string"
    got, _ = run(spark, O.elements(fed(spark, f"{tmp_path}/e", rows, schema), "1000 days", 60_000), f"{tmp_path}/e")
    want = targets.stable_elements(spark.createDataFrame(rows, schema))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
