"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, reduced, shared_dir, table

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes | None, digest: str, length: int, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit without a payload."""
    revisit = refers_to is not None
    block = HTTP % length + (b"" if revisit else payload)
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record in raw; ValueError where its version, heads, lengths or digest are wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC version line")
    heads = {}
    for x in lines[1:]:
        name, colon, value = x.partition(b":")
        if not colon:
            raise ValueError("a head without a colon")
        heads[name.decode("utf-8").lower()] = value.strip().decode("utf-8")
    if missing := {"warc-type", "warc-record-id", "warc-payload-digest", "content-length"} - heads.keys():
        raise ValueError(f"heads missing: {sorted(missing)}")
    size = int(heads["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    if not mark or not http.startswith(b"HTTP/1.1 ") or b"Content-Length" not in fields:
        raise ValueError("no HTTP head")
    length, kind, digest = int(fields[b"Content-Length"]), heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest differs")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    number = lambda k: int(x) if (x := heads.get(k, "")[10:-1]) else None
    return {"page_id": number("warc-record-id"), "url": heads.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None}


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def _filesystem(folder: str):
    from pyarrow import fs

    folder = re.sub("^s3[an]://", "s3://", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(pages: DataFrame, folder: str, sample: int = 200, dictionary: int = 16384, level: int = 3, roll: int = 256 << 20) -> DataFrame:
    """Write an archive per task, a new one after roll bytes; rows (path, records, bytes).

    pages: page_id, url, html, payload_digest, payload_bytes, refers_to. Each archive's dictionary is trained on the first
    sample payloads of its task, a bounded number. A file is written under a name of its own attempt and listed only by a
    task that ends, so a task that is run again leaves no half archive in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, at = _filesystem(folder)
        out = comp = None
        done: list[tuple] = []
        n = size = 0

        def close():
            nonlocal out, n, size
            if out is not None:
                out.close()
                done.append((path, n, size))
            out, n, size = None, 0, 0

        for b in batches:
            for r in b.to_pylist():
                payload = (r["html"] or "").encode("utf-8")
                if comp is None:
                    seen = [(x or "").encode("utf-8")[:65536] for x in b.column("html").slice(0, sample).to_pylist()]
                    try:
                        data = zstandard.train_dictionary(dictionary, seen, k=256, d=8, threads=0)
                    except zstandard.ZstdError:  # too few samples: their text itself
                        data = zstandard.ZstdCompressionDict(b"".join(seen)[:dictionary] or b"<html>", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    data.precompute_compress(level=level)
                    comp = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
                if out is None:
                    path = f"{at}/{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(path)
                    out.write(dictionary_frame(data.as_bytes()))
                frame = comp.compress(record(r["page_id"], r["url"], payload, r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "records": k, "bytes": s} for p, k, s in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    return pages.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def frames(stream, block: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame each, read in blocks; ValueError for a frame that is cut short."""
    start = stream.read(8)
    kind, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    if kind != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary frame")
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary is cut short")
    if data[:4] == zstandard.FRAME_HEADER:
        data = zstandard.ZstdDecompressor().decompress(data)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    held, parts, one = b"", [], None
    while True:
        chunk = held or stream.read(block)
        held = b""
        if not chunk:
            if one is not None:
                raise ValueError("a frame is cut short")
            return
        if one is None:
            one = reader.decompressobj()
        parts.append(one.decompress(chunk))
        if one.eof:
            yield b"".join(parts)
            held, parts, one = one.unused_data, [], None


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives in column path: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                held, n, size = [], 0, 0
                with system.open_input_stream(path) as f:
                    for raw in frames(f):
                        held.append(parse(raw))
                        n, size = n + 1, size + len(raw)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, types)
                            held, size = [], 0
                if n != records:
                    raise ValueError(f"{path}: {n} records, not {records}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, types)

    return archives.select("path", "records").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null for a response).

    Of equal payloads of least bytes or more, the row with the largest page_id is the response and all others refer to it,
    those with a null page_id too; where all page_ids are null there is nothing to refer to, and all are responses. Of
    several rows with that page_id, the one with the least url is the response (any one of equal rows). Null html is an
    empty payload. No rows: none.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select("page_id", "url", "html", F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    small, d = d.where(F.col("payload_bytes") < least), d.where(F.col("payload_bytes") >= least)
    ids = d.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    same = ids.groupBy(F.col("payload_digest").alias("same")).agg(F.max(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("all"))
    same = same.where("all > 1 and first.page_id is not null").select("same", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("firsts"))
    # rows that can't be of a repeated first page_id take their texts along to be told from revisits
    again = same.where("firsts > 1").select(F.col("same").alias("payload_digest"), F.col("first_id").alias("page_id"))
    key = ["payload_digest", "page_id"]
    far = reduced(d, key, again, key, how="left_anti").join(same, F.col("payload_digest") == F.col("same"), "left")
    plain = far.select(*d.columns, F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    # of the others, one text a payload goes along; equal rows are counted before they meet, and each is a record again
    near = reduced(d, key, again, key)
    texts = near.groupBy(F.col("payload_digest").alias("text_of")).agg(F.min("html").alias("html"))
    many = near.groupBy("page_id", "url", "payload_digest", "payload_bytes").agg(F.count("*").alias("n"))
    many = many.join(same.select("same", "first_id"), F.col("payload_digest") == F.col("same"), "left")
    least_url = many.where("page_id = first_id").groupBy(F.col("payload_digest").alias("own")).agg(F.min(F.struct(F.col("url").isNotNull().alias("known"), "url")).alias("least"))
    many = many.join(least_url, F.col("payload_digest") == F.col("own"), "left").join(texts, F.col("payload_digest") == F.col("text_of"))
    many = many.withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    response = (F.col("k") == 1) & F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("least.url"))
    return small.withColumn("refers_to", F.lit(None).cast("long")).union(plain).union(many.select(*d.columns, F.when(~response, F.col("first_id")).alias("refers_to")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back, as with_revisits() marks them; no rows: none."""
    shared_dir(spark)
    folder = new_folder(spark, "warc")
    pages = with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    write(pages, f"{folder}/archives").write.parquet(f"{folder}/list")
    listed = spark.read.parquet(f"{folder}/list")
    n = max(1, listed.count())
    back = read(listed.repartition(n), f"{folder}/archives")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = """
with p as (
  select page_id, url, encode(coalesce(html, '')) as b from pages),
q as (select page_id, url, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
r as (
  select *, max(page_id) over (partition by payload_digest) as m, row_number() over (partition by payload_digest, page_id order by url nulls first) as k from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and m is not null and (page_id is distinct from m or k > 1) then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and (page_id is distinct from m or k > 1) then m end as refers_to, url
from r
"""
