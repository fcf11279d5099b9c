"""WARC archives with per-record Zstandard frames and an embedded dictionary.

Each task writes one ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) holds a
dictionary built from the first records of that file, and every record is a frame of its own
compressed with it, so any record can be read alone. Of equal payloads of at least
``least`` bytes the one with the smallest page_id is a response and the others are revisits
that carry only the HTTP header, the payload's digest and a reference.

Edge cases: a null html is an empty payload; a null url is written as an empty target; a null
page_id never becomes the record that others refer to unless no other page has that payload;
rows with equal page_id and html are each a response if that page_id is the smallest; an
empty table writes no file; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch

SKIPPABLE = 0x184D2A5D  # fixed value: the dictionary frame of the WARC-Zstandard format
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: WARC 1.1
DATE = "2000-01-01T00:00:00Z"
LEAST = 100
#: The dictionary is built from a file's first records up to so many bytes.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 20


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; of few records their own bytes; none without records."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few or too small records to train on
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Holds the first records for the dictionary, then writes frame by frame."""

    def __init__(self, stream):
        self.stream, self.waiting, self.held, self.press = stream, [], 0, None

    def add(self, data: bytes) -> None:
        if self.press:
            self.stream.write(self.press.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        learned = dictionary(self.waiting)
        if learned:
            raw = learned.as_bytes()
            self.stream.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.press = zstandard.ZstdCompressor(level=6, dict_data=learned, write_checksum=True)
        for data in self.waiting:
            self.stream.write(self.press.compress(data))
        self.waiting = []

    def close(self) -> None:
        if not self.press:
            self.begin()
        self.stream.close()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = scratch.open_fs(folder)
        name, writer, n = uuid.uuid4().hex, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    writer = Writer(fs.open_output_stream(f"{path}/.{name}"))
                writer.add(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"]))
                n += 1
        if writer is None:
            return
        writer.close()
        fs.move(f"{path}/.{name}", f"{path}/{name}.warc.zst")  # only whole files have this name, and only reported ones are read
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.zst"]), pa.array([n], pa.int64())], ["file", "records"])

    return run


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in ``folder``; returns file, records."""
    body = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html"), F.sha2(body, 256).alias("digest"), F.length(body).alias("bytes"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # Only payloads that recur are joined against; a large group of copies sits on the side that Spark can split.
    marked = rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return scratch.save(spark, marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder), "file string, records long"), "archives")


def records(stream) -> Iterator[bytes]:
    """The records of an archive one by one; one frame is in memory at a time."""
    held = stream.read(8)
    learned = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
        learned, held = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", held[4:])[0])), b""
    reader = zstandard.ZstdDecompressor(dict_data=learned)
    while held or (held := stream.read(READ_BYTES)):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(READ_BYTES)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(held))
            held = b""
        held = frame.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    return page and int(page), length, digest, fields["WARC-Type"], refers and int(refers)


COLUMNS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, (_, t) in enumerate(COLUMNS)], schema=pa.schema(COLUMNS))

    for batch in batches:
        for file in batch.column("file").to_pylist():
            fs, path = scratch.open_fs(file)
            found = []
            with fs.open_input_file(path) as stream:
                for data in records(stream):
                    found.append(parse(data))
                    if len(found) == 10_000:
                        yield out(found)
                        found = []
            yield out(found)


def read_warc(files: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return files.repartition(max(1, files.count()), "file").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
