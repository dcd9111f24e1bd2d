"""Frame files in blocks: small on disk, read from any frame on, whole or growing, and those of the kind before."""

import struct

import numpy as np
from pyspark.sql import functions as F

from callatlas.plans import media
from callatlas.sources import frame_files as S

SCHEMA = "call_id long, frame_idx int, pts_s double, width int, height int, pixels binary"


def rows_of(calls, n, w, h, still):
    r = np.random.default_rng(2)
    image = r.integers(0, 255, (h, w)).astype(np.uint8)
    return [(c, k, k / 4, w, h, (image if still else r.integers(0, 255, (h, w)).astype(np.uint8)).tobytes()) for c in range(calls) for k in range(n)]


def read(spark, path, columns=(), **options):
    return sorted((int(x["call_id"]), *(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in tuple(x)[1:])) for x in S.frames(spark, f"file://{path}", columns, **options).collect())


def test_files_of_still_frames_are_small(spark, tmp_path):
    rows = rows_of(2, 1000, 64, 48, True)
    S.write_frames(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/f").collect()
    assert sum(p.stat().st_size for p in (tmp_path / "f").iterdir()) * 20 < sum(len(r[5]) for r in rows)
    assert read(spark, tmp_path / "f", part_bytes=50_000) == rows
    assert read(spark, tmp_path / "f", ("call_id", "frame_idx", "pts_s")) == [r[:3] for r in rows]


def test_a_file_grows_block_by_block(spark, tmp_path):
    rows = rows_of(1, 13, 500, 400, False)  # five frames a block
    S.write_frames(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/f").collect()
    assert read(spark, tmp_path / "f", part_bytes=3 * 200_008) == rows
    file = tmp_path / "f" / "0.gray"
    whole = file.read_bytes()
    first = [len(whole.split(b"\n", 1)[0]) + 1]
    while len(first) < 4:
        first.append(first[-1] + 12 + sum(struct.unpack_from("<2I", whole, first[-1] + 4)))
    for size, n in ((first[0], 0), (first[1] - 1, 0), (first[1], 5), (first[1] + 7, 5), (first[2] + 100, 10), (first[3], 13), (first[3] + 3, 13), (len(whole) - 1, 13), (len(whole), 13)):
        file.write_bytes(whole[:size])
        assert read(spark, tmp_path / "f") == rows[:n], size


def test_files_of_the_kind_before_are_read(spark, tmp_path):
    rows = rows_of(2, 30, 24, 16, False)
    for c in range(2):
        (tmp_path / f"{c}.gray").write_bytes(b"GRAY1 24 16\n" + b"".join(struct.pack("<d", r[2]) + r[5] for r in rows if r[0] == c) + b"half")
    assert read(spark, tmp_path) == read(spark, tmp_path, part_bytes=3000) == rows
    assert read(spark, tmp_path, ("call_id", "pts_s")) == [(r[0], r[2]) for r in rows]


def test_small_files_share_a_partition(spark, tmp_path):
    S.write_frames(spark.createDataFrame(rows_of(40, 2, 8, 8, False), SCHEMA), f"file://{tmp_path}/f").collect()
    assert S.frames(spark, f"file://{tmp_path}/f").rdd.getNumPartitions() == 1
    assert S.frames(spark, f"file://{tmp_path}/f", part_bytes=10 * 72).rdd.getNumPartitions() == 8


def test_frames_are_written_where_they_are_drawn(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "write_frames", lambda df, path, **options: seen.append(write(df, path, **options)) or seen[-1])
    d = "/root/testdata/sf0.001"
    got = media.filed(spark, d).select("call_id", "frame_idx", "pts_s", F.md5("pixels").alias("m"))
    want = media.frames(spark, d).select("call_id", "frame_idx", "pts_s", F.md5("pixels").alias("m"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("draw(")]
    assert "Exchange" not in above and "Sort" not in above


write = S.write_frames
