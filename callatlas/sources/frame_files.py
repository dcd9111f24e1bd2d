"""Files of gray frames as a Spark data source, for batches and streams.

A file holds one call's frames: a line `GRAY2 <width> <height>`, then blocks of frames. A block has three numbers of four bytes,
least byte first: its frames, and the bytes of the two parts that follow, times (doubles, in seconds) and pixels (width * height
bytes a frame), each compressed by zstd. A file that is whole ends with a table of its blocks; one that still grows has none, and
its blocks are found one after the other. Partitions are ranges of frames, of many files if these are small. Files of the kind before,
`GRAY1` and records of a time and its pixels as they are, are read too.
Paths may be of any file system that Arrow knows; the call's name is the file's name without its ending.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "call_id string, frame_idx int, pts_s double, width int, height int, pixels binary"
ENDING, MAGIC, PLAIN = ".gray", b"GRAY2", b"GRAY1"
#: Bytes of a partition where pixels are read, and frames of one where they are not; bytes of a batch; bytes of pixels of a block.
PART_BYTES, PART_FRAMES, BATCH_BYTES, BLOCK_BYTES = 64_000_000, 100_000, 8_000_000, 1_000_000
#: Before a block; behind the table, where it begins. A table is a block without frames, with the number of blocks for the times.
HEAD, TAIL, END = struct.Struct("<3I"), struct.Struct("<Q8s"), b"GRAYEND\n"


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


@dataclass
class Part:
    path: str
    call: str
    start: int
    stop: int


@dataclass
class Parts(InputPartition):
    parts: list[Part]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else "file:///" + path)


class _File:
    """An open file of frames: its size of a frame, the number of complete ones, and where they are."""

    def __init__(self, f: pa.NativeFile, path: str, size: int):
        line = f.read(64).split(b"\n", 1)[0]
        kind, *of = line.split() or [b""]
        if kind not in (MAGIC, PLAIN) or len(of) != 2:
            raise ValueError(f"{path} is no file of gray frames")
        self.f, self.width, self.height, self.head = f, int(of[0]), int(of[1]), len(line) + 1
        self.size = self.width * self.height
        if kind == PLAIN:
            self.blocks, self.frames = None, max(0, size - self.head) // (8 + self.size)
        else:
            self.blocks = self._table(size)
            self.frames = int(self.blocks[:, 0].sum())

    def _table(self, size: int) -> np.ndarray:
        """(frames, bytes of times, bytes of pixels) of each complete block."""
        f, at, found = self.f, self.head, []
        if size >= self.head + HEAD.size + TAIL.size:
            f.seek(size - TAIL.size)
            table, end = TAIL.unpack(f.read(TAIL.size))
            if end == END:
                f.seek(table)
                _, n, packed = HEAD.unpack(f.read(HEAD.size))
                return np.frombuffer(_zstd().decompress(f.read(packed), 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        while at + HEAD.size <= size:
            f.seek(at)
            block = HEAD.unpack(f.read(HEAD.size))
            at += HEAD.size + block[1] + block[2]
            if not block[0] or at > size:
                break
            found.append(block)
        return np.array(found, np.int64).reshape(-1, 3)

    def read(self, start: int, stop: int, pixels: bool) -> Iterator[tuple[int, np.ndarray, pa.Buffer | None]]:
        """(first frame, times, pixels) of the frames from start to stop, a block at a time; pixels are left where they are if not wanted."""
        if self.blocks is None:
            step = max(1, BATCH_BYTES // (8 + self.size)) if pixels else 10_000
            for a in range(start, stop, step):
                rows = []
                for k in range(a, min(stop, a + step)):
                    self.f.seek(self.head + k * (8 + self.size))
                    rows.append(self.f.read(8 + self.size if pixels else 8))
                yield a, np.array([struct.unpack_from("<d", r)[0] for r in rows]), pa.py_buffer(b"".join(r[8:] for r in rows)) if pixels else None
            return
        codec, first, at = _zstd(), 0, self.head
        for n, times, packed in self.blocks.tolist():
            if first < stop and first + n > start:
                a, b = max(start - first, 0), min(stop - first, n)
                self.f.seek(at + HEAD.size)
                t = np.frombuffer(codec.decompress(self.f.read(times), 8 * n), "<f8")[a:b]
                yield first + a, t, codec.decompress(self.f.read(packed), n * self.size).slice(a * self.size, (b - a) * self.size) if pixels else None
            first, at = first + n, at + HEAD.size + times + packed


def _listed(path: str) -> Iterator[tuple[str, str, int, int]]:
    """(path, call, bytes of a frame, complete frames) of each file under path."""
    system, at = _open(path)
    for f in sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path):
        if f.type == fs.FileType.File and f.base_name.endswith(ENDING) and not f.base_name.startswith((".", "_")):
            with system.open_input_file(f.path) as x:
                file = _File(x, f.path, f.size)
            yield f.path, f.base_name.removesuffix(ENDING), 8 + file.size, file.frames


class _Frames:
    """What batches and streams share: partitions of ranges of frames, and reading one."""

    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def parts(self, done: dict[str, int], until: dict[str, int] | None = None) -> list[Parts]:
        """Ranges that together have the bytes or frames of a partition, one after the other."""
        out, room = [], 0
        for path, call, size, n in _listed(self.path):
            size, most = (size, self.part_bytes) if "pixels" in self.columns else (1, PART_FRAMES)
            a, n = done.get(path, 0), n if until is None else until.get(path, 0)
            while a < n:
                if room < size:
                    room = max(most, size)
                    out.append(Parts([]))
                b = min(n, a + room // size)
                out[-1].parts.append(Part(path, call, a, b))
                a, room = b, room - (b - a) * size
        return out

    def read(self, p: Parts) -> Iterator[pa.RecordBatch]:
        """Pixels are read only where the schema asks for them."""
        system, _ = _open(self.path)
        pixels = "pixels" in self.columns
        for part in p.parts:
            with system.open_input_file(part.path) as x:
                f = _File(x, part.path, x.size())
                for first, times, data in f.read(part.start, part.stop, pixels):
                    n = len(times)
                    same = lambda v, t: pa.array([v] * n, t)
                    all_ = {
                        "call_id": lambda: same(part.call, pa.string()), "frame_idx": lambda: pa.array(range(first, first + n), pa.int32()), "pts_s": lambda: pa.array(times, pa.float64()),
                        "width": lambda: same(f.width, pa.int32()), "height": lambda: same(f.height, pa.int32()),
                        "pixels": lambda: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * f.size).astype("<i4")), data]),
                    }
                    yield pa.RecordBatch.from_arrays([all_[c]() for c in self.columns], self.columns)


class FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> list[Parts]:
        return self.parts({}) or [Parts([])]


class FrameStream(_Frames, DataSourceStreamReader):
    """Frames as files grow: an offset is the number of complete frames of each file."""

    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps({path: n for path, *_, n in _listed(self.path)})}

    def partitions(self, start: dict, end: dict) -> list[Parts]:
        return self.parts(json.loads(start["frames"]), json.loads(end["frames"]))

    def commit(self, end: dict) -> None:
        """Nothing is kept for frames that have been read."""


class GrayFrames(DataSource):
    """spark.read.format("gray_frames").load(folder); a schema with fewer columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "gray_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(schema, self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(schema, self.options)


def frames(spark: SparkSession, path: str, columns: tuple[str, ...] = (), stream: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """A10: the frames of the files under path, or a stream of them; columns: those that are wanted, all if none are named;
    part_bytes: bytes of pixels of a partition at most."""
    spark.dataSource.register(GrayFrames)
    wanted = ", ".join(c for c in SCHEMA.split(", ") if not columns or c.split()[0] in columns)
    return (spark.readStream if stream else spark.read).format("gray_frames").schema(wanted).option("partbytes", part_bytes).load(path)


class _Writer:
    """A file of one call's frames; the pixels of a block are held until it is full."""

    def __init__(self, out: pa.NativeFile, width: int, height: int):
        self.out, self.size, self.n, self.blocks, self.times, self.images = out, width * height, 0, [], [], []
        out.write(MAGIC + f" {width} {height}\n".encode())

    def add(self, time: float, pixels: bytes) -> None:
        if self.images and (len(self.images) + 1) * self.size > BLOCK_BYTES:
            self._block()
        self.times.append(time)
        self.images.append(pixels)
        self.n += 1

    def _block(self) -> None:
        codec = _zstd()
        t, p = codec.compress(struct.pack(f"<{len(self.times)}d", *self.times)), codec.compress(b"".join(self.images))
        self.blocks.append((len(self.times), len(t), len(p)))
        for part in (HEAD.pack(*self.blocks[-1]), t, p):
            self.out.write(part)
        self.times, self.images = [], []

    def close(self) -> None:
        if self.images:
            self._block()
        at, table = self.out.tell(), _zstd().compress(np.array(self.blocks, "<u4").tobytes())
        for part in (HEAD.pack(0, len(self.blocks), len(table)), table, TAIL.pack(at, END)):
            self.out.write(part)
        self.out.close()


def write_frames(frames_: DataFrame, path: str, by_call: bool = False) -> DataFrame:
    """(call_id, n): writes each call's frames, in order, to a file of its own under path, and tells how many. A file is
    written under another name and moved when it is whole, so a task that is run again replaces it. All frames of a call have one size.
    by_call: each call's frames lie in one task and in order already, so pixels need no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(path)
        system.create_dir(at, recursive=True)
        now, out, last, size = None, None, None, None

        def closed() -> pa.RecordBatch:
            out.close()
            system.move(f"{at}/_{now}{ENDING}", f"{at}/{now}{ENDING}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([out.n], pa.int64())], ["call_id", "n"])

        for b in batches:
            for call, k, t, w, h, pixels in zip(*(b.column(c).to_pylist() for c in ("call_id", "frame_idx", "pts_s", "width", "height", "pixels")), strict=True):
                if call != now:
                    if out:
                        yield closed()
                    now, size, last, out = call, (w, h), None, _Writer(system.open_output_stream(f"{at}/_{call}{ENDING}"), w, h)
                if (w, h) != size or len(pixels) != w * h:
                    raise ValueError(f"a frame of {call} has another size")
                if last is not None and k < last:
                    raise ValueError(f"the frames of {call} are not in order")
                last = k
                out.add(t, pixels)
        if out:
            yield closed()

    f = frames_.select(F.col("call_id").cast("string").alias("call_id"), "frame_idx", "pts_s", "width", "height", "pixels")
    if not by_call:
        f = f.repartition("call_id").sortWithinPartitions("call_id", "frame_idx")
    return f.mapInArrow(run, "call_id string, n long")
