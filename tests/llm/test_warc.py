import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from turnwise.llm.warc import dechunk, http_payload, read_archives, read_records, resolve_revisits, write_archives

PAGES = "page_id long, url string, html string, digest string, row string, block int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(prose):
    long = prose(40_000) + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    return [
        (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "x\r\ny: z", ""), (5, "u", long),
        (6, "u", long), (None, "u", "no id"), (7, "u", "Zürich 東京 \U0001f600 " * 3_000), (8, "u", "\r\n0\r\n\r\n"), (8, "u", "twice"),
        (8, "u", "twice"), (9, "u", "x" * 4096), (10, "u", "x" * 16_384), (None, "u", "<p>one</p>")]


def written(spark, pages, folder, **options):
    write_archives(spark.createDataFrame([(*p, "x", "y", 0) for p in pages], PAGES), folder, **options)
    return read_archives(spark, folder)


@pytest.mark.parametrize("segment, chunk", [(16_384, 4096), (50, 7)])
def test_round_trip(spark, pages, tmp_path, segment, chunk):
    pages = pages if segment > 50 else [p for p in pages if len(p[2] or "") < 20_000]
    records = written(spark, pages, str(tmp_path / "w"), segment=segment, chunk=chunk)
    got = records.collect()
    assert len(got) == len(pages) and not any(r.problem for r in got)
    groups = {}
    for i, _, html in pages:
        groups.setdefault(html or "", []).append(i)
    origin = {h: max((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    want = sorted(
        (str(i), len((h or "").encode()), digest(h), "response" if i == origin[h or ""] else "revisit",
         None if i == origin[h or ""] else str(origin[h or ""])) for i, _, h in pages)
    full = [tuple(None if x is None else x for x in r) for r in resolve_revisits(records).select(
        F.coalesce("id", F.lit("None")), "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(full) == want
    payloads = sorted(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert payloads == sorted(h or "" for i, _, h in pages if i == origin[h or ""])


def test_small_payloads_are_not_revisited(spark, tmp_path):
    got = written(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], str(tmp_path / "w"), min_bytes=3).collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in got) == [
        ("1", "response", None), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None)]


def test_no_pages(spark, tmp_path):
    assert resolve_revisits(written(spark, [], str(tmp_path / "w"))).collect() == []


def test_lost_and_broken_segments(spark, tmp_path):
    written(spark, [(1, "u", "a" * 300), (2, "u", "b" * 300)], str(tmp_path / "w"), segment=100)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    records = data.split(b"WARC/1.1\r\n")[1:]
    assert len(records) == sum(1 for _ in read_records(gzip.compress(data)))
    lost = [r for r in records if not (b"X-Page-ID: 1\r\n" in r and b"WARC-Segment-Number: 2\r\n" in r)]
    short = [r.replace(b"Total-Length: ", b"Total-Length: 1") if b"X-Page-ID: 2\r\n" in r else r for r in lost]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + r) for r in short))
    got = {r.id: (r.payload, r.problem) for r in read_archives(spark, str(tmp_path / "broken")).collect()}
    assert got == {"1": (None, "segments are missing or repeated"), "2": (None, "the total length differs")}


def test_framing():
    assert dechunk(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"x\r\n"):
        with pytest.raises(ValueError):
            dechunk(bad)
