"""WARC archives, compressed record by record with a Zstandard dictionary.

Every task writes one archive: a leading skippable frame that holds a dictionary
trained on records of that archive, then one compressed frame for each record, so
single records can be read alone.  Payloads that occur before (equal SHA-256, at
least ``LEAST`` bytes) become revisit records that refer to the one with the smallest id.

Archives are written by Spark's own text writer, so its commit protocol covers lost and
repeated tasks and any file system that Spark knows will do.  That writer ends each
row with a separator; here that is an empty skippable frame, which readers pass over.

Defined cases: a NULL payload is empty; payloads under ``LEAST`` bytes are all responses;
rows that share the smallest id of their payload are all responses; a row without an id
is never referred to, and without rows with ids in its group it is a response; NULL
addresses are written empty; payloads are stored whole; empty tables give archives
without records.
"""

from __future__ import annotations

import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.llm.common import as_bytes, ship

#: Bytes of the smallest payload that is worth a reference.
LEAST = 100
#: Bytes of a dictionary, and of the records that it is trained on.
DICTIONARY = 64 << 10
SAMPLE = 4 << 20
LEVEL = 3
#: Fixed values of the formats: a skippable frame with a dictionary, one without content, a frame.
DICTIONARY_MAGIC = 0x184D2A5D
SKIP = b"P*M\x18\x00\x00\x00\x00"
FRAME_MAGIC = 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def record_urn(page_id: str | None, digest: str) -> str:
    """An id that depends on the row alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: response with its payload, or revisit with the HTTP header alone."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    address = re.sub(r"[\r\n]", " ", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A record's id, address, type, payload length and digest, the id it refers to, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    return fields.get("X-Page-Id"), fields["WARC-Target-URI"], kind, length, digest, fields.get("X-Refers-To-Page-Id"), payload if kind == "response" else None


def trained(records: list[bytes]) -> bytes:
    """A dictionary from records; empty if they are too few."""
    samples = [r[i : i + 16384] for r in records for i in range(0, min(len(r), 131072), 16384)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def unframed(content: bytes):
    """The records of an archive."""
    data, at, dictionary = memoryview(content), 0, None
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == FRAME_MAGIC:
            reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            yield reader.decompressobj().decompress(data[at:end])
        elif magic == DICTIONARY_MAGIC and end > at + 8:
            dictionary = zstandard.ZstdCompressionDict(bytes(data[at + 8 : end]))
        at = end


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of every row."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    originals = (
        rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    )
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(originals, "digest", "left").withColumn("refers_to", F.when(again, F.col("original"))).drop("original")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write archives under ``path``, one for each task; ``date`` is the capture time that the records carry."""
    ship(pages.sparkSession)
    rows = resolved(pages, page_id, url, payload).select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def records(batches):
        for batch in batches:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            yield from (record(*x, date) for x in zip(ids, urls, as_bytes(batch.column(2)), digests, refers, strict=True))

    def frames(batches):
        source, first, size = records(batches), [], 0
        for r in source:
            first.append(r)
            size += len(r)
            if size >= SAMPLE:
                break
        if not first:
            return
        dictionary = trained(first)
        options = {"level": LEVEL, "write_checksum": True}
        compressor = zstandard.ZstdCompressor(**options)
        out: list[bytes] = []
        if dictionary:
            compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **options)
            out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        held = sum(map(len, out))
        for part in (first, source):
            for r in part:
                out.append(compressor.compress(r))
                held += len(out[-1])
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SKIP.decode("latin-1")).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``; a revisit has no payload of its own."""
    ship(spark)

    def records(batches):
        for batch in batches:
            for content in as_bytes(batch.column(0)):
                rows, size = [], 0
                for data in unframed(content):
                    rows.append(parsed(data))
                    size += len(data)
                    if size >= 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    page, url, kind, length, digest, refers, payload = zip(*rows, strict=True) if rows else [()] * 7
    s = pa.string()
    return pa.RecordBatch.from_arrays(
        [pa.array(page, s), pa.array(url, s), pa.array(kind, s), pa.array(length, pa.int64()), pa.array(digest, s), pa.array(refers, s), pa.array(payload, pa.binary())],
        ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"],
    )
