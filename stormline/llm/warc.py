"""WARC archives as seekable Zstandard bundles.

Each task writes its records into archives in the shared folder: records are grouped into independent Zstandard
frames of about `frame_bytes`, and an archive ends with a seek table in a skippable frame that lists every frame's
compressed and plain size. A written index maps record ids to archive, frame and offset within the plain frame, so
one record is read by seeking to its frame alone. Archive names hold a random part; only those named by the
committed index count, so what a lost or repeated task attempt has left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_folder

FRAME_BYTES, ARCHIVE_BYTES, LEVEL = 1 << 20, 64 << 20, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format, fixed values
INDEX = "record_id string, page_id bigint, archive string, frame int, frame_offset bigint, frame_size bigint, offset bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def from_urn(text: str | None) -> int | None:
    number = (text or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the full payload's digest and length, but no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    """One archive; `add` returns (frame, offset in the frame) of a record."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.plain, self.table, self.size = io.BytesIO(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.plain.tell() and self.plain.tell() + len(data) > self.frame_bytes:
            self._flush()
        at = self.plain.tell()
        self.plain.write(data)
        return len(self.table), at

    def _flush(self) -> None:
        plain = self.plain.getvalue()
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain)))
        self.size += len(packed)
        self.plain = io.BytesIO()

    def close(self) -> list[tuple[int, int]]:
        """Writes what is left and the seek table; returns (offset, size) of each frame."""
        if self.plain.tell():
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        frames, at = [], 0
        for packed, _ in self.table:
            frames.append((at, packed))
            at += packed
        return frames


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, from the footer of an open archive."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the archive")
    file.seek(size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        out.append((at, packed, plain))
        at += packed
    return out


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at an offset of a plain frame."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin, size = end + 4, int(head["Content-Length"])
    return head, data[begin : begin + size], begin + size + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def entry(head: dict[str, str], body: bytes, payloads: bool = True) -> tuple:
    """A row of RECORD. Length and digest of a response are those of the body read, which the headers must match; a revisit has
    no body, and its headers' values."""
    response = head["WARC-Type"] == "response"
    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:]
    if response:
        found = len(body), digest_of(body)
        if found != (size, digest):
            raise ValueError(f"record {head['WARC-Record-ID']}: payload of {found[0]} bytes, sha1 {found[1]}, but the headers say {size}, {digest}")
        size, digest = found
    return (
        from_urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], from_urn(head.get("WARC-Refers-To")),
        body if payloads and response else None,
    )


def revisits(pages: DataFrame, *, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to) of the records that revisit another; groups are found on digests alone."""
    body = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("sha"), F.octet_length(body).alias("size")).filter(F.col("size") >= min_bytes).drop("size")
    kept = materialise(own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return materialise(own.join(kept, "sha").filter(F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull())).distinct())


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes one record per row below `folder` and returns the written index.

    Of records with equal payloads of at least `min_bytes`, that with the largest id is the response and the others
    revisit it; rows that share this id are all responses. Smaller payloads are all responses. A null html is an
    empty payload, a null url leaves its header out. A row with a null id revisits a row that has one. Characters
    outside the URI set are percent-encoded in the header. Other columns are ignored.
    """
    twins = revisits(pages, id_col=id_col, html_col=html_col, min_bytes=min_bytes).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to")
    body = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("sha"))
    rows = rows.join(twins, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "body", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(folder)
        store.create_dir(root, recursive=True)
        writer, path, entries = None, "", []

        def finish() -> pa.RecordBatch:
            frames = writer.close()
            cols = list(zip(*[(urn(p), p, path, f, *frames[f], o, n) for p, f, o, n in entries]))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c for c in batch.columns]):
                page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()
                if writer is None:
                    path, entries = f"{root}/{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(store.open_output_stream(path, compression=None), frame_bytes)
                digest = digest_of(payload)
                data = record(page_id, url, payload, digest, refers_to, refers_to is not None)
                entries.append((page_id, *writer.add(data), len(data)))
                if writer.size >= archive_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return materialise(rows.mapInArrow(run, INDEX))


def read(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """All records of the archives that the index names: each task takes some archives and reads them frame by
    frame, as their own seek tables say. With payloads=False the payload column is null, but every
    payload is still measured and hashed; one that differs from its headers is an error."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = place(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    for at, packed, plain in seek_table(file, file.size()):
                        file.seek(at)
                        data, rows, at = unpack.decompress(file.read(packed), max_output_size=plain), [], 0
                        while at < len(data):
                            head, body, at = parse(data, at)
                            rows.append(entry(head, body, payloads))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    archives = index.select("archive").distinct().repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.mapInArrow(run, RECORD)


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose page_id is in `wanted`: one seek and one frame per record, without reading the rest."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = place(folder)
        for batch in batches:
            rows = []
            for path, at, size, offset in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(path) as file:
                    file.seek(at)
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(size))
                head, body, _ = parse(data, offset)
                rows.append(entry(head, body))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    places = index.join(wanted.select("page_id").distinct(), "page_id").select("archive", "frame_offset", "frame_size", "offset")
    return places.mapInArrow(run, RECORD)


def roundtrip(pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages and reads the archives back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc"
    return read(write(pages, folder, min_bytes=min_bytes), folder, payloads=False).drop("payload", "url")
