"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``;
a bundle is a run of frames followed by a footer seek table (a skippable
frame that lists every frame's compressed and decompressed size). Any standard
decompressor reads a bundle as one stream; a reader that knows a record's frame
and its offset there decompresses that frame alone.

Bundles are written by Spark's file writer, so they go to any store Spark can
write to, with its commit protocol for lost tasks. Each bundle is one row of
the text writer and one file: the row holds all bytes but the last, and the line
separator is that last byte (the seek table's magic number ends in 0x8F).

Of records with equal payloads of at least ``min_bytes`` the one with the smallest
id is a ``response``; the others are ``revisit`` records that refer to it and
carry no payload. Digests are bare upper-case base32 SHA-1 of the whole payload.

Defined cases: a null payload is empty; a null URL is written without a target URI;
rows with a null id are written under an empty id and never referred to (they are
always responses); repeated rows (same id and payload) are one response and
revisits that refer to that id; ties of payloads go to the smallest id; a very long payload is one record, whole, in a frame of
its own size; an empty table has no bundles and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm.common import lookup, materialize
from weighbridge.session import ensure_checkpoint_dir

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20  # compressed; a bundle is closed at the record that reaches it
# ---- fixed values: the Zstandard seekable format ----
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames of ``(compressed, decompressed)`` bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed, decompressed)`` of each frame."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def warc_record(page_id, url, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse_records(data: bytes):
    """``(offset, headers, payload)`` of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def base32_digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def assign_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, refers_to``. Payloads move once, by id; digests alone find equal ones."""
    keys = pages.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("len"))
    keys = materialize(keys.where(F.col("page_id").isNotNull() & (F.col("len") >= min_bytes)), "warc-keys")
    total = keys.count()
    first = keys.groupBy("sha", "len").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = lookup(keys, first, ["sha", "len"], ["refers_to"], "copies", total, "page_id", how="inner")
    # all but one row of each first page are revisits: a repeated row refers to its own id
    copies = copies.groupBy("page_id", "sha", "len", "refers_to").agg(F.count(F.lit(1)).alias("times"))
    revisits = materialize(copies.where((F.col("page_id") != F.col("refers_to")) | (F.col("times") > 1)), "warc-revisits")
    narrow = revisits.select("page_id", "refers_to", F.col("sha").alias("_sha"), F.col("len").alias("_len"))
    same = (pages["page_id"] == narrow["page_id"]) & (F.sha1(pages["payload"]) == narrow["_sha"]) & (F.length(pages["payload"]) == narrow["_len"])
    out = pages.join(narrow, same, "left").select(pages["page_id"], pages["url"], pages["payload"], "refers_to")
    if revisits.where(F.col("page_id") == F.col("refers_to")).isEmpty():
        return out
    again = F.row_number().over(Window.partitionBy("page_id", "refers_to").orderBy(F.col("url").asc_nulls_first()))
    own = F.col("page_id") == F.col("refers_to")
    return out.withColumn("_nth", F.when(own, again)).withColumn("refers_to", F.when(~own | (F.col("_nth") > 1), F.col("refers_to"))).drop("_nth")


def write_bundles(records: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes ``records`` (``page_id, url, payload, refers_to``) as bundle files under ``path``."""

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        out, sizes, frame, held = [], [], [], 0

        def close_frame():
            plain = b"".join(frame)
            out.append(packer.compress(plain))
            sizes.append((len(out[-1]), len(plain)))

        def bundle():
            data = b"".join(out) + seek_table(sizes)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = warc_record(page_id, url, b"" if refers_to is not None else payload, base32_digest(payload), len(payload), refers_to)
                frame.append(record)
                held += len(record)
                if held >= frame_bytes:
                    close_frame()
                    frame, held = [], 0
                    if sum(s for s, _ in sizes) >= bundle_bytes:
                        yield bundle()
                        out, sizes = [], []
        if frame:
            close_frame()
        if sizes:
            yield bundle()

    rows = records.select("page_id", "url", "payload", "refers_to").mapInArrow(pack, "value binary")
    # a string column keeps the bytes as they are; one row a file; the separator completes the magic number
    writer = rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", "\u008f").text(path)


def read_bundles(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles under ``path``: its headers' fields, a recomputed digest for
    responses, and its place: bundle file, frame number and offset in the frame."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_start long, frame_bytes long, frame_offset long"
    names = [f.split()[0] for f in fields.split(", ")] + ["payload"] * with_payload

    def unpack(batches):
        import zstandard

        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer().to_pybytes()
                for number, (start, packed, plain) in enumerate(read_seek_table(data)):
                    rows = []
                    for offset, head, payload in parse_records(reader.decompress(data[start : start + packed], max_output_size=plain)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and digest != base32_digest(payload):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']} in {name}")
                        ids = [head.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        page_id, refers_to = (int(i) if i else None for i in ids)
                        row = (page_id, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers_to, name, number, start, packed, offset)
                        rows.append((*row, payload) if with_payload else row)
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, _ARROW.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, fields + (", payload binary" if with_payload else ""))


_ARROW = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "bundle": pa.string(), "frame": pa.int32(), "payload": pa.binary()}


def read_records(spark, path: str, index: DataFrame, ids: DataFrame) -> DataFrame:
    """``page_id, payload`` of the wanted records by random access: ``index`` is the place columns
    of :func:`read_bundles`; of each bundle only the frames that hold a wanted record are decompressed."""

    def fetch(batches):
        import zstandard

        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames = {(p["frame_start"], p["frame_bytes"]) for p in places}
                plain = {s: reader.decompress(data[s : s + n]) for s, n in frames}
                found = [next(parse_records(plain[p["frame_start"]][p["frame_offset"] :])) for p in places]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([p["page_id"] for p in places], pa.int64()), "payload": pa.array([f[2] for f in found], pa.binary())})

    wanted = index.join(ids, "page_id", "left_semi").groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame_start", "frame_bytes", "frame_offset")).alias("places"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("bundle"), "content")
    return files.join(wanted, "bundle").select("content", "places").mapInArrow(fetch, "page_id long, payload binary")


def archive_pages(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (``page_id, url, html``) to bundles under ``path`` (default: a new
    folder beside the checkpoints) and returns :func:`read_bundles` of them."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    write_bundles(assign_roles(rows, min_bytes), path, frame_bytes, bundle_bytes)
    return read_bundles(spark, path)
