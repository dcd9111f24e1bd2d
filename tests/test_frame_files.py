"""Frames in files: written, read in parts, in a stream, and through the frame operators."""

import numpy as np
from pyspark.sql import functions as F

from callatlas.operators import frames as P
from callatlas.sources import frame_files as S


def drawn(spark, calls=3, n=40, w=24, h=16):
    r = np.random.default_rng(4)
    rows = []
    for c in range(calls):
        image = r.integers(0, 80, (h, w)).astype(np.uint8)
        for k in range(n + c):
            if k % 5 == c:
                image = image.copy()
                image[4:10, 6:14] = r.integers(0, 255)
            rows.append((c, k, k / 4, w, h, image.tobytes()))
    return rows, spark.createDataFrame(rows, "call_id long, frame_idx int, pts_s double, width int, height int, pixels binary")


def test_files_hold_what_was_written(spark, tmp_path):
    rows, df = drawn(spark)
    path = f"file://{tmp_path}/f"
    assert {(r["call_id"], r["n"]) for r in S.write_frames(df, path).collect()} == {("0", 40), ("1", 41), ("2", 42)}
    got = S.frames(spark, path, part_bytes=4000)
    assert got.rdd.getNumPartitions() > 3
    assert sorted((int(r[0]), *r[1:5], bytes(r[5])) for r in got.collect()) == sorted(rows)
    times = S.frames(spark, path, ("call_id", "pts_s"))
    assert times.columns == ["call_id", "pts_s"] and sorted((int(a), b) for a, b in times.collect()) == sorted((r[0], r[2]) for r in rows)
    scored = lambda d: sorted(tuple(r)[1:] for r in P.frame_scores(d.withColumn("call_id", F.col("call_id").cast("long"))).collect())
    assert scored(got) == scored(df)
    (tmp_path / "empty").mkdir()
    assert S.frames(spark, f"file://{tmp_path}/empty").collect() == []


def test_scores_from_files_are_a_plain_loop(spark, tmp_path):
    rows, df = drawn(spark, 2, 20)
    path = f"file://{tmp_path}/f"
    S.write_frames(df, path).collect()
    got = {(r["call_id"], r["frame_idx"]): r["fraction"] for r in P.frame_scores(S.frames(spark, path).withColumn("call_id", F.col("call_id").cast("long"))).collect()}
    want = {}
    for (c, k, _, w, h, b), (c0, _, _, _, _, a) in zip(rows[1:], rows, strict=False):
        if c == c0:
            x, y = (np.frombuffer(p, np.uint8).reshape(h, w).astype(int) for p in (a, b))
            want[c, k] = P.block_difference(x.astype(np.uint8), y.astype(np.uint8))[0]
    assert got == want and any(want.values())


def test_a_stream_takes_frames_as_files_grow(spark, tmp_path):
    rows, df = drawn(spark, 2, 12)
    path = tmp_path / "f"
    S.write_frames(df, f"file://{path}").collect()
    whole = (path / "1.gray").read_bytes()
    (path / "1.gray").write_bytes(whole[: len(whole) // 2 + 3])  # the last frame is not whole yet
    feed = S.frames(spark, f"file://{path}", ("call_id", "frame_idx", "pts_s"), stream=True)

    def run(stream, name):
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}")

    first = run(feed, "all").count()
    assert first < len(rows)
    (path / "1.gray").write_bytes(whole)
    got = run(feed, "all")
    assert sorted((int(r["call_id"]), r["frame_idx"], r["pts_s"]) for r in got.collect()) == [r[:3] for r in rows]
