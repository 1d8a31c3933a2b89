"""WARC archives whose records share a Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard frame);
then every WARC record is a Zstandard frame of its own that uses it. The dictionary is built from
records of the whole table: those with the smallest hash of their id, a bounded number, each cut
to a bounded length for training only. It is at most ``dictionary_bytes`` long, so every archive
can carry it.

Of records with equal payloads of at least ``revisit_bytes`` the one with the largest id is a
response and the others are revisits of it. Equality is by SHA-1, the digest that the archive
itself carries. Rows that repeat the largest id are responses too. NULL payloads are empty, NULL
ids never the largest; without ids, or below the bound, everything is a response. An empty table
gives no archive and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm import files
from calibrant.llm.tables import shuffle_width, written
from calibrant.operators.joins import salted_join
from calibrant.session import run_folder

# Fixed values of the WARC and WARC-Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id bigint, path string, at bigint, length bigint"
RECORDS = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
           "record_type string, refers_to bigint, record_id string")


@dataclass(frozen=True)
class Archive:
    """Parameters of the archives."""

    revisit_bytes: int = 1000
    dictionary_bytes: int = 64 << 10
    training_records: int = 400       # bound of the sample the dictionary is trained on ...
    training_bytes: int = 8 << 10     # ... and of what it takes from each record
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _header(fields: list[tuple[str, object]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None),
             f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + body + b"\r\n\r\n"


def format_record(row: dict, date: str) -> bytes:
    """One WARC record; a revisit has no body and names the response and the payload's size."""
    page, url, refers_to = row["page_id"], row["url"], row["refers_to"]
    revisit = refers_to is not None
    # A line break would end the header line.
    uri = None if url is None else "".join(url.split("\r")).replace("\n", "%0A")
    return _header([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Page-ID", page),
        ("X-Refers-To-Page-ID", refers_to),
        ("X-Payload-Length", row["payload_bytes"]),
    ], b"" if revisit else row["payload"])


def parse_record(content: bytes) -> dict:
    """The fields of one record; a response's digest and length are taken from its payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    payload, end = rest[:size], rest[size:]
    if len(payload) != size or end != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    page, refers_to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != named:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": named, "record_type": kind,
        "refers_to": None if refers_to is None else int(refers_to),
        "record_id": fields["WARC-Record-ID"],
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@functools.lru_cache(maxsize=4)
def _dictionary(content: bytes):
    return zstandard.ZstdCompressionDict(content) if content else None


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


class RecordReader:
    """Records of one archive: all in a row, or the one at a given place."""

    def __init__(self, source):
        self._source = source
        source.seek(0)
        magic, length = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError("the archive does not start with a dictionary frame")
        dictionary = zstandard.ZstdDecompressor().decompress(source.read(length))
        self._first = 8 + length
        known = _dictionary(dictionary)
        self._zstd = zstandard.ZstdDecompressor(**({"dict_data": known} if known else {}))

    def at(self, place: int, length: int) -> bytes:
        self._source.seek(place)
        return self._zstd.decompressobj().decompress(self._source.read(length))

    def __iter__(self) -> Iterator[bytes]:
        self._source.seek(self._first)
        pending = self._source.read(_CHUNK)
        while pending:
            frame, parts = self._zstd.decompressobj(), []
            while True:
                parts.append(frame.decompress(pending))
                if frame.eof:
                    pending = frame.unused_data or self._source.read(_CHUNK)
                    break
                pending = self._source.read(_CHUNK)
                if not pending:
                    raise ValueError("the archive ends inside a record")
            yield b"".join(parts)


def with_revisits(pages: DataFrame, archive: Archive) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (NULL for responses).

    Digests are counted with a map-side combine, and only digests that occur twice meet the rows
    again, spread by salt, so a third of all rows may share one payload.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn(
        "payload_digest", F.sha1("payload"))
    # A digest with its length; short payloads get no partner, whatever their digest.
    shared = (
        rows.filter(F.col("payload_bytes") >= archive.revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select("payload_digest", "response"))
    joined = salted_join(rows, shared, ["payload_digest"], "left", F.col("page_id"))
    refers = F.when(
        F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id")),
        F.col("response"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def build_dictionary(pages: DataFrame, archive: Archive) -> bytes:
    """Trained on the records with the smallest hash of their id."""
    order = F.coalesce(F.xxhash64("page_id"), F.lit(0))
    # Hashes first: a task sends numbers to the driver, and records only those that are chosen.
    lowest = pages.select(order.alias("order")).orderBy("order").limit(
        archive.training_records).agg(F.max("order").alias("last")).head().last
    if lowest is None:
        return b""
    part = F.substring(F.col("html").cast("string").cast("binary"), 1, archive.training_bytes)
    sample = (
        pages.filter(order <= lowest)
        .select(F.col("page_id").cast("bigint").alias("page_id"),
                F.col("url").cast("string").alias("url"),
                F.coalesce(part, F.lit(b"")).alias("payload"), order.alias("order"))
        .orderBy("order", "payload").limit(archive.training_records))
    records = []
    for row in sample.collect():
        payload = bytes(row.payload)
        records.append(format_record({
            "page_id": row.page_id, "url": row.url, "payload": payload, "refers_to": None,
            "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(),
        }, archive.date))
    return train_dictionary(records, archive.dictionary_bytes)


def write_archives(pages: DataFrame, archive: Archive = Archive(), folder: str | None = None) -> DataFrame:
    """Write the archives; returns the index, one row per record."""
    spark = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    dictionary = build_dictionary(pages, archive)
    lead = leading_frame(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _dictionary(dictionary)
        zstd = zstandard.ZstdCompressor(level=archive.level, **({"dict_data": known} if known else {}))
        sink = path = None
        place = 0
        for batch in batches:
            if sink is None and batch.num_rows:
                path = files.new_file(folder, TaskContext.get().partitionId(), ".warc.zst")
                sink = files.open_output(path)
                sink.write(lead)
                place = len(lead)
            places, lengths = [], []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for values in zip(*columns):
                row = {n: v.as_py() for n, v in zip(batch.schema.names, values)}
                frame = zstd.compress(format_record(row, archive.date))
                sink.write(frame)
                places.append(place)
                lengths.append(len(frame))
                place += len(frame)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([path] * len(places), pa.string()),
                 pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "path", "at", "length"])
        if sink is not None:
            sink.close()

    return written(with_revisits(pages, archive).mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that ``index`` names, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, size = [], 0
                for content in RecordReader(files.open_input(path)):
                    found.append(parse_record(content))
                    size += len(content)
                    if size > _CHUNK * 4:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, size = [], 0
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    # Dealt out in turn: by key, the few short rows would be put together in one task.
    paths = index.select("path").distinct().repartition(shuffle_width(index.sparkSession))
    return paths.mapInArrow(read, RECORDS)


def page_table(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Write, read back, and describe: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    return read_archives(write_archives(pages, archive)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
