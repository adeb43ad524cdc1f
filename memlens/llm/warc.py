"""WARC archives: a writer of one gzip member per record, and a reader that splits files at any byte.

A reading task owns a byte range.  It looks for gzip magic from the range's start, takes a place as a member only if the
member inflates in full, with its checksum, to a WARC header, and is followed by another such header or the end of the
file; then it follows members one by one and keeps those that start inside its range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.session import cut, ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT_BYTES = 100
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
LEVEL = 4
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): of equal payloads of at least MIN_REVISIT_BYTES bytes, all but the
    smallest id refer to it.  Counts per digest combine on the map side; payloads are not shuffled with them."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).select("id", "digest").join(first, "digest").where("id > first").select(
        F.col("id").alias("_id"), F.col("first").alias("refers_to")).distinct()
    return rows.join(later, F.col("id") == F.col("_id"), "left").drop("_id")


def _safe(value: str) -> str:
    """A header value on one line: control characters, blanks and % are percent-encoded."""
    return re.sub(r"[\x00-\x20%\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def _plain(value: str) -> str:
    return bytes(re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block of its own but carries the length of the payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {_safe(url)}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"  # a repeated task writes another file; only finished ones are listed
        records = size = 0
        out = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                member = _gzip(record(*row))
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([size]), pa.array([records])], ["file", "bytes", "records"])

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(file, bytes, records) of the archives written to ``folder``, one per non-empty partition.

    The list is checkpointed: a task that ran twice leaves an unlisted file, which readers never see.
    """
    return cut(records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(_write(folder), "file string, bytes long, records long"))


class Tail:
    """A file from some byte on, read in pieces of READ_BYTES."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def more(self) -> bool:
        left = self.size - self.at - len(self.data)
        if left <= 0:
            return False
        self.file.seek(self.at + len(self.data))
        self.data += self.file.read(min(READ_BYTES, left))
        return True

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def member(self, start: int = 0, whole: bool = True) -> tuple[bytes, int] | None:
        """(content, length) of the WARC member ``start`` bytes on, or None if there is none.  Not ``whole``: only the
        first bytes are inflated, enough to see a WARC header."""
        unpack = zlib.decompressobj(31)
        out, fed = [], start
        got = 0
        while True:
            if fed >= len(self.data) and not self.more():
                return None
            piece = self.data[fed : fed + 65536]
            try:
                part = unpack.decompress(piece)
            except zlib.error:
                return None
            fed += len(piece)
            out.append(part)
            got += len(part)
            if got >= 5 and b"".join(out)[:5] != b"WARC/":
                return None
            out = [b"".join(out)] if got < 5 else out
            if unpack.eof:
                return (b"".join(out), fed - len(unpack.unused_data) - start) if got >= 5 else None
            if not whole and got >= 5:
                return out[0], 0


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, end)."""
    tail = Tail(file, size, start)
    while tail.at < end:  # the first member of the range
        place = tail.data.find(MAGIC)
        if place < 0:
            keep = min(len(tail.data), len(MAGIC) - 1)
            tail.skip(len(tail.data) - keep)
            if not tail.more():
                return
            continue
        tail.skip(place)
        if tail.at >= end:
            return
        found = tail.member()
        if found and (tail.at + found[1] == size or tail.member(found[1], whole=False)):
            break
        tail.skip(1)
    while tail.at < end and tail.at < size:
        found = tail.member()
        if found is None:
            raise ValueError(f"no WARC record at byte {tail.at}")
        yield found[0]
        tail.skip(found[1])


def _read(folder: str):
    names = ["id", "url", "payload", "digest", "payload_bytes", "record_type", "refers_to"]
    number = re.compile(r"<urn:page:(-?\d+)>")

    def rows_of(raws: list[bytes]) -> pa.RecordBatch:
        rows = []
        for raw in raws:
            fields, block = parse(raw)
            own, other = number.match(fields["WARC-Record-ID"]), number.match(fields.get("WARC-Refers-To", ""))
            kind = fields["WARC-Type"]
            if kind == "response":
                digest, length = hashlib.sha256(block).hexdigest(), len(block)
                if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
            else:
                digest, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
            rows.append((own and int(own[1]), _plain(fields["WARC-Target-URI"]), block if kind == "response" else None, digest, length, kind, other and int(other[1])))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    held, held_bytes = [], 0
                    for raw in members(file, size, start, end):
                        held.append(raw)
                        held_bytes += len(raw)
                        if held_bytes > 4 << 20:
                            yield rows_of(held)
                            held, held_bytes = [], 0
                    if held:
                        yield rows_of(held)

    return run


def read_archives(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the listed files: (id, url, payload, digest, payload_bytes, record_type, refers_to).

    Files are cut into ranges of ``range_bytes`` wherever that falls; every record is read by the one task whose range
    holds its first byte.  A revisit's payload is null; digest and length are those of the payload it stands for.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("file", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    schema = "id long, url string, payload binary, digest string, payload_bytes long, record_type string, refers_to long"
    return ranges.repartition("file", "start").mapInArrow(_read(folder), schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write every row as a WARC record, read the archives back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload, a null url an empty one.  Rows with a null key are responses with a null key; rows that
    repeat a key share its fate.  An empty table writes no file and reads no row.
    """
    folder = archive_folder(pages.sparkSession)
    files = write_archives(plan_records(pages, key, url, html), folder)
    return read_archives(files, folder, range_bytes).select(F.col("id").alias(key), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
