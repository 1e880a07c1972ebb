"""WARC archives in Zstandard: a writer and a reader that takes the dictionary from the leading skippable frame.

Each archive is one skippable frame with the dictionary, then one frame for each record. Archives are of bounded size;
the reader gets whole ones from Spark's binary files source and checks every frame, header and length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import Tables
from kinograph.session import ship_package

# Fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:kinograph:page:"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Payloads of so many bytes and more are stored once.
LEAST_REVISIT = 100
#: Uncompressed bytes of an archive, about; pages and bytes of each that train the dictionary, and its size.
ARCHIVE_BYTES, SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 300, 16384, 64 << 10
_STEP = 1 << 15


class ArchiveError(ValueError):
    """An archive that isn't what its format asks for."""


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: headers, HTTP headers, and for responses the payload. A page_id may stand for several payloads, so that a
    record is named by both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_URN}{page_id}:{digest}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}:{digest}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> dict:
    """Headers and payload of one whole record; raises ArchiveError where a header or a length is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION + b"\r\n"):
        raise ArchiveError("a record doesn't begin with its version line")
    headers = headers_of(head)
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ArchiveError(f"a record lacks {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{headers['warc-record-id']}: its block isn't as long as Content-Length says")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError(f"{headers['warc-record-id']}: no HTTP headers")
    length = int(headers_of(http).get("content-length", -1))
    if headers["warc-type"] == "response" and length != len(payload) or headers["warc-type"] == "revisit" and payload:
        raise ArchiveError(f"{headers['warc-record-id']}: a payload of {len(payload)} bytes where {length} are announced")
    if headers["warc-type"] == "revisit" and ("warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE):
        raise ArchiveError(f"{headers['warc-record-id']}: a revisit that doesn't say of what")
    return {"headers": headers, "payload": payload, "http_length": length}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_dictionary(data: bytes) -> tuple[bytes, int]:
    """The dictionary of an archive's leading skippable frame (which may itself be a Zstandard frame), and that frame's end."""
    if len(data) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME or 8 + size > len(data):
        raise ArchiveError("the leading frame holds no dictionary")
    raw = bytes(data[8 : 8 + size])
    return (zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27) if raw.startswith(ZSTD_MAGIC) else raw), 8 + size


def records(data: bytes) -> Iterator[dict]:
    """The records of one archive, a frame at a time."""
    dictionary, at = read_dictionary(data)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(view):
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise ArchiveError(f"no frame begins at byte {at}")
        frame, parts = context.decompressobj(), []
        begin = at
        while not frame.eof:
            if at >= len(view):
                raise ArchiveError(f"the frame at byte {begin} isn't whole")
            try:
                parts.append(frame.decompress(view[at : at + _STEP]))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the frame at byte {begin} can't be decoded: {e}") from e
            at = min(at + _STEP, len(view))
        at -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of SAMPLE_PAGES pages, those with the smallest hashes of page_id; it changes the
    archives' size alone. Empty where the sample is too small."""
    # numbers first, so that no partition sends the texts of a sample of its own
    chosen = pages.where("html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    some = pages.where("html is not null").join(F.broadcast(chosen.distinct()), "page_id", "left_semi")
    samples = [r[0].encode() for r in some.select(F.substring("html", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; null html: empty) and gives (path, records, bytes).

    Of rows with equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others are
    revisits of it; rows that repeat a page_id and payload are alike. Rows without a page_id are left out. folder has to be a URI that pyarrow can write to from every host.
    An archive appears under its name once it is whole; a task that runs again writes the same names and contents.
    """
    spark = pages.sparkSession
    ship_package(spark)
    dictionary = train_dictionary(pages)
    rows = pages.where("page_id is not null").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = large.join(firsts, "digest").where("page_id > first").distinct()
    # pages are dealt by page_id and ordered in each part, so that a part's archives are the same whenever it is written
    dealt = rows.join(later, ["page_id", "digest"], "left").sortWithinPartitions("page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        frames: list[bytes] = []
        size = number = 0

        def store() -> pa.RecordBatch:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            name = f"{base}/{part:06d}-{number:04d}.warc.zst"
            temporary = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
            data = dictionary_frame(dictionary) + b"".join(frames)
            with system.open_output_stream(temporary) as out:
                out.write(data)
            system.move(temporary, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(frames)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                page_id, digest, url, html, first = r
                raw = record_bytes(page_id, url, html.encode(), digest, "response" if first is None else "revisit", first)
                frames.append(compressor.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield store()
                    frames.clear()
                    size, number = 0, number + 1
        if frames:
            yield store()

    return dealt.select("page_id", "digest", "url", "html", "first").mapInArrow(run, "path string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, url, declared_digest, declared_bytes, payload) of every record of the archives in
    folder; payload is null for revisits. Fails with ArchiveError where an archive is damaged."""
    ship_package(spark)

    def page_of(urn: str | None) -> int | None:
        return int(urn.strip("<>").removeprefix(RECORD_URN).partition(":")[0]) if urn else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "url", "declared_digest", "declared_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                size = 0
                for r in records(data.as_buffer()):
                    h = r["headers"]
                    kind = h["warc-type"]
                    rows.append((page_of(h["warc-record-id"]), kind, page_of(h.get("warc-refers-to")), h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha256:"), r["http_length"], r["payload"] if kind == "response" else None))
                    size += len(r["payload"])
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, refers_to long, url string, declared_digest string, declared_bytes long, payload binary")


def measured(found: DataFrame) -> DataFrame:
    """The records with their payloads' size and SHA-256 in the place of the payloads."""
    return found.select("page_id", "record_type", "refers_to", "declared_digest", "declared_bytes", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))


def resolve(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of found, which has measured()'s columns: a revisit's
    length and digest are those of the response it refers to, by page_id and payload; fails where there is none, or where they
    aren't those that its headers declare. Joins deal records by both, and Spark splits those of a payload with many copies."""
    own = found
    wrong = lambda size, digest: F.when((F.col("declared_bytes") != F.col(size)) | (F.col("declared_digest") != F.col(digest)) | F.col(digest).isNull(), F.raise_error(F.concat(F.lit("record doesn't match its headers: "), F.col("page_id").cast("string")))).otherwise(F.col(size))
    responses = own.where("record_type = 'response'").select("page_id", wrong("size", "digest").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    targets = own.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared_digest"), F.col("size").alias("of_size"), F.col("digest").alias("of_digest")).distinct()
    revisits = own.where("record_type = 'revisit'").drop("size", "digest").join(targets, ["refers_to", "declared_digest"], "left")
    revisits = revisits.select("page_id", wrong("of_size", "of_digest").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.union(revisits)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Writes an archive record for each page into the shared folder, reads the archives back and gives what they hold."""
    tables = Tables(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = tables.folder("archives")
    written = write_archives(pages, folder).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()
    if not written.n:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolve(tables.keep(measured(read_archives(spark, folder))))
