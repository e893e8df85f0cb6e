"""Archives: each record alone by its offset, revisits, damage, odd rows."""

import base64
import gzip
import hashlib
import io
import json
import zlib
from pathlib import Path

import pytest
from tests.oracle import spark_rows, sql_rows

from acrelight.llm import entry, warc

from .conftest import with_clashes

PAGES = "page_id long, url string, html string"


def read(spark, rows, folder, **options):
    pages = with_clashes(spark.createDataFrame(rows, PAGES))
    return warc.read_archives(warc.archive_pages(pages, str(folder), **options), f"{folder}/normalised").collect()


def test_equal_payloads_revisit_the_smallest_id(spark, tmp_path):
    long_page = "<p>é漢</p>\r\n\r\n" * 300_000
    rows = [(5, "http://a/", "x"), (3, "http://b/ü\r\nX: y", "x"), (9, None, None), (8, "http://c/", ""), (7, "u", long_page), (6, "u", long_page), (None, "u", "x"), (None, "u", "z"), (None, "v", "z"), (4, "t", "WARC/1.1\r\n\r\n"), (2, "r", "w"), (2, "r", "w")]
    found = read(spark, rows, tmp_path)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert len(found) == len(rows)
    for r in found:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert r.payload_digest == digest(r.payload.decode())
            assert r.payload_bytes == len(r.payload)
    by = lambda text: sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to) for r in found if r.payload_digest == digest(text))
    assert by("x") == [(False, 3, "response", None), (False, 5, "revisit", 3), (True, None, "revisit", 3)]
    assert by("") == [(False, 8, "response", None), (False, 9, "revisit", 8)]
    assert by(long_page) == [(False, 6, "response", None), (False, 7, "revisit", 6)]
    assert sorted(by("w"), key=str) == [(False, 2, "response", None), (False, 2, "revisit", 2)]
    assert sorted(x[2] for x in by("z")) == ["response", "revisit"]
    assert {r.payload_bytes for r in found if r.payload_digest == digest(long_page)} == {len(long_page.encode())}


def test_files_are_archives_whose_members_stand_alone(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(40)]
    assert len(read(spark, rows, tmp_path)) == 40
    for captured in tmp_path.glob("captured/*.gz"):
        one = zlib.decompressobj(31)
        one.decompress(captured.read_bytes())
        assert one.eof and not one.unused_data  # a single gzip member
    seen = 0
    for file in tmp_path.glob("normalised/*.gz"):
        data = file.read_bytes()
        entries = [json.loads(x) for x in Path(f"{file}.idx").read_text().splitlines()]
        assert sum(e["length"] for e in entries) == len(data)
        whole = gzip.decompress(data)
        assert whole == b"".join(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries)
        assert [h["WARC-Record-ID"] for h, _ in warc.records_of(io.BytesIO(data))] == [e["id"] for e in entries]
        seen += sum(e["type"] != "warcinfo" for e in entries)
    assert seen == 40


def test_small_payloads_stay_responses(spark, tmp_path):
    found = read(spark, [(1, "a", "xy"), (2, "a", "xy"), (3, "a", "x"), (4, "a", "x")], tmp_path, least_bytes=2)
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (2, "revisit"), (3, "response"), (4, "response")]


def test_archives_close_when_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, "u", f"{i % 3}" * 900) for i in range(9)]
    captured = warc.capture(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/c")
    assert captured.count() == 9


def test_empty_table(spark, tmp_path):
    assert read(spark, [], tmp_path) == []


def test_damage_is_an_error():
    good = gzip.compress(warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "x")], b"body"))
    assert [b for _, b in warc.records_of(io.BytesIO(good + good))] == [b"body", b"body"]
    for bad in (good[:-9], gzip.compress(b"no archive\r\n\r\n"), gzip.compress(gzip.decompress(good)[:-7]), b""):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records_of(io.BytesIO(bad)))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(entry.queries()["op13_warc"](spark, sf)) == sql_rows(entry.oracle_sql()["op13_warc"], sf)
