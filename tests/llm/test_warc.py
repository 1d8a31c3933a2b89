import hashlib
import struct

import pyarrow.fs as fs
import pytest
import zstandard

import cases
from calibrant.llm import warc
from calibrant.llm.catalog import QUERIES

PAGES = "page_id bigint, url string, html string"
BIG, HUGE = "<p>" + "long page " * 150, "é" * 400_000
ROWS = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (None, "http://a/n", BIG),
    (2, "http://a/2", "short"), (4, "http://a/4", "short"),
    (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a\r\n/8", HUGE),
    (9, "http://a/9", "x" * 999), (10, "http://a/10", "x" * 999),
    (11, "http://a/11", "y" * 1000), (12, "http://a/12", "y" * 1000), (12, "http://a/12", "y" * 1000),
    (None, None, "alone " * 300), (None, None, "alone " * 300),
]


def expected(rows):
    best = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            best[body] = max(best.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = best.get(body)
        to = None if to == page else to
        out.append((page, len(body), hashlib.sha1(body).hexdigest(),
                    "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    pages = spark.createDataFrame(ROWS, PAGES)
    if clashing:
        pages = pages.selectExpr("*", "1 AS payload", "2 AS path", "3 AS response", "4 AS `order`")
    assert cases.table(warc.page_table(pages)) == expected(ROWS)


def test_query(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", "html").collect()]
    assert cases.table(QUERIES["op2_warc"](spark, sf_dir)) == expected(rows)


def test_empty_table(spark):
    assert warc.page_table(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_carry_their_dictionary(spark):
    rows = [(i, f"http://a/{i}", f"<html><title>{i}</title>" + "common words here " * 9 + str(i * i))
            for i in range(300)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES)).collect()
    content = {}
    for row in index:
        system, path = fs.FileSystem.from_uri(row.path) if "://" in row.path or row.path.startswith(
            "file:") else (fs.LocalFileSystem(), row.path)
        if row.path not in content:
            content[row.path] = system.open_input_file(path).read()
    for path, data in content.items():
        magic, length = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdDecompressor().decompress(data[8:8 + length])
        known = zstandard.ZstdCompressionDict(dictionary)
        assert known.dict_id() != 0
        zstd = zstandard.ZstdDecompressor(dict_data=known)
        mine = sorted((r.at, r.length, r.page_id) for r in index if r.path == path)
        assert mine[0][0] == 8 + length and mine[-1][0] + mine[-1][1] == len(data)
        for at, size, page in mine:
            # Each record by itself, from its place alone.
            record = zstd.decompressobj().decompress(data[at:at + size])
            assert warc.parse_record(record)["payload"] == rows[page][2].encode()
    with_dictionary = sum(r.length for r in index)
    alone = sum(len(zstandard.compress(warc.format_record(
        {"page_id": p, "url": u, "payload": h.encode(), "refers_to": None, "payload_bytes": len(h),
         "payload_digest": hashlib.sha1(h.encode()).hexdigest()}, "2000-01-01T00:00:00Z")))
        for p, u, h in rows)
    assert with_dictionary < 0.6 * alone


def test_damage_is_noticed():
    row = {"page_id": 1, "url": "u", "payload": b"body", "refers_to": None, "payload_bytes": 4,
           "payload_digest": hashlib.sha1(b"body").hexdigest()}
    record = warc.format_record(row, "2000-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"body"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record.replace(b"body", b"bodi"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record[:-1])
