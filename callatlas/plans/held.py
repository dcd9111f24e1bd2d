"""Tables that a query uses several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_root(spark) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine only, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="spark-held-")


def held(df: DataFrame) -> DataFrame:
    """df computed once and read back; the folder is that of shared_root()."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
