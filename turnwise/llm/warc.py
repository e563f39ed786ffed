"""WARC archives of web pages: writing with revisits and segments, and reading back with reassembly.

A response block is an HTTP message with chunked transfer framing; blocks above ``segment`` characters are
split into a first segment and continuation records.  Records with equal payloads are found by a grouped
maximum over digests, so pages are shuffled once, by digest.

Reading takes the archives file by file.  Unsegmented records are decoded where they are read; only
the segments of others are shuffled, by the identifier of their origin, put in order by segment
number, checked against the total length, and decoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, query, table
from turnwise.session import cut_lineage, new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
RECORDS_PER_FILE = 2_000
DECODED = (
    "row long, id string, url string, record_type string, refers_to string, payload binary, payload_digest string, "
    "problem string")
SEGMENTS = (
    "origin string, number int, total long, row long, id string, url string, claimed string, record_type string, "
    "refers_to string, block binary")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(text: str, size: int) -> list[str]:
    return [text[at:at + size] for at in range(0, len(text), size)]


def _field(name: str, value) -> str:
    """A header line, or nothing for a null value."""
    return "" if value is None else f"{name}: {value}{EOL}"


def frame_task(chunk: int, segment: int):
    """Task function: pages (row, id, url, html, hex, origin, revisit) to the text of their records, one or more each."""
    def records(r) -> Iterator[str]:
        head = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"
        if r.revisit:
            block = head + EOL
        else:
            framed = [f"{len(c.encode('utf-8', 'surrogatepass')):x}{EOL}{c}{EOL}" for c in _pieces(r.html, chunk)]
            block = "".join([head, f"Transfer-Encoding: chunked{EOL}{EOL}", *framed, f"0{EOL}{EOL}"])
        parts = _pieces(block, segment)
        digest = base64.b32encode(bytes.fromhex(r.hex)).decode()
        length = sum(len(p.encode("utf-8", "surrogatepass")) for p in parts)
        for at, part in enumerate(parts):
            first, last = at == 0, at + 1 == len(parts)
            split = len(parts) > 1
            yield "".join([
                f"WARC/1.1{EOL}",
                _field("WARC-Type", "continuation" if not first else "revisit" if r.revisit else "response"),
                _field("WARC-Record-ID", f"<urn:row:{r.row}>" if first else f"<urn:row:{r.row}:{at}>"),
                _field("WARC-Target-URI", r.url), _field("X-Row", r.row), _field("X-Page-ID", r.id),
                _field("WARC-Payload-Digest", f"sha1:{digest}"),
                _field("WARC-Refers-To", f"<urn:page:{r.origin}>" if r.revisit else None),
                _field("WARC-Segment-Number", at + 1 if split else None),
                _field("WARC-Segment-Origin-ID", None if first else f"<urn:row:{r.row}>"),
                _field("WARC-Segment-Total-Length", length if split and last else None),
                _field("Content-Type", "application/http; msgtype=response"),
                _field("Content-Length", len(part.encode("utf-8", "surrogatepass"))), EOL, part])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for r in batch.itertuples(index=False):
                for record in records(r):
                    some.append(record)
                    size += len(record)
                    if size > 4 << 20:
                        yield pd.DataFrame({"value": some})
                        some, size = [], 0
            if some:
                yield pd.DataFrame({"value": some})
    return run


def write_archives(
    pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    chunk: int = 4096, segment: int = 16_384,
) -> None:
    """A WARC record for each row of ``pages``, in gzipped archives in ``folder``.

    The payload is the html in UTF-8, of a null empty.  Of records with equal payloads of at least
    ``min_bytes`` bytes, those with the largest id are responses and the others revisit them (a null id
    is the smallest); shorter payloads are all responses.  Repeated rows become records of their own.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"),
        F.regexp_replace(F.col(url), r"[\r\n]", " ").alias("url"), full(html).alias("html")).withColumn("hex", F.sha1("html"))
    origins = rows.where(F.octet_length("html") >= min_bytes).groupBy("hex").agg(F.max("id").alias("origin"))
    marked = rows.join(origins, "hex", "left").select(
        "row", F.col("id").cast("string").alias("id"), "url", "html", "hex", F.col("origin").cast("string").alias("origin"),
        ((F.octet_length("html") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("origin"))).alias("revisit"))
    # Two line ends close a record, so they are the separator of the text sink.
    marked.mapInPandas(frame_task(chunk, segment), "value string").write.option("lineSep", EOL * 2).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one at a time."""
    file = io.BufferedReader(_Gunzipped(data), 1 << 20)
    while version := file.readline():
        if version.strip() == b"":
            continue
        headers = {}
        while (line := file.readline().strip()):
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        yield headers, file.read(int(headers["content-length"]))


class _Gunzipped(io.RawIOBase):
    """The unpacked bytes of a gzip file in memory, some at a time; members may follow each other."""

    def __init__(self, data: bytes):
        self.data, self.at, self.unpack, self.rest = data, 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.unpack.eof:
                left = self.unpack.unused_data + self.data[self.at:]
                if not left:
                    return 0
                self.data, self.at, self.rest, self.unpack = left, 0, b"", zlib.decompressobj(31)
            packed = self.rest or self.data[self.at:self.at + (1 << 16)]
            if not self.rest:
                self.at += len(packed)
            if not packed:
                return 0
            out = self.unpack.decompress(packed, len(buffer))
            self.rest = self.unpack.unconsumed_tail
            if out:
                buffer[:len(out)] = out
                return len(out)


def dechunk(body: bytes) -> bytes:
    """The bytes inside chunked transfer framing; ``ValueError`` where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it says")
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, without transfer framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _decoded(kind: str | None, blocks: list[bytes], claimed: str | None) -> dict:
    """Payload, its digest (hashed once) and what is wrong with them; of a revisit the digest that it states."""
    if kind == "revisit":
        return {"payload": None, "payload_digest": claimed, "problem": None}
    try:
        payload = http_payload(b"".join(blocks))
    except ValueError as e:
        return {"payload": None, "payload_digest": None, "problem": str(e)}
    digest = payload_digest(payload)
    return {
        "payload": payload, "payload_digest": digest,
        "problem": "the digest differs" if claimed is not None and digest != claimed else None}


def _common(h: dict[str, str]) -> dict:
    refers = h.get("warc-refers-to")
    return {
        "row": int(h.get("x-row", -1)), "id": h.get("x-page-id"), "url": h.get("warc-target-uri"),
        "refers_to": refers.removeprefix("<urn:page:").removesuffix(">") if refers else None,
        "claimed": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}


def _frames(rows: Iterator[dict], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of some megabytes."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row.get("payload") or row.get("block") or b"") + 200
        if size > 4 << 20:
            yield pd.DataFrame(some, columns=columns)
            some, size = [], 0
    if some:
        yield pd.DataFrame(some, columns=columns)


def read_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: archives to decoded records that aren't segmented."""
    def rows():
        for batch in batches:
            for data in batch["content"]:
                for h, block in read_records(data):
                    if "warc-segment-number" in h:
                        continue
                    common = _common(h)
                    yield common | {"record_type": h["warc-type"]} | _decoded(h["warc-type"], [block], common["claimed"])
    return _frames(rows(), [c.split()[0] for c in DECODED.split(", ")])


def read_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: archives to the segments of segmented records."""
    def rows():
        for batch in batches:
            for data in batch["content"]:
                for h, block in read_records(data):
                    if "warc-segment-number" in h:
                        total, number = h.get("warc-segment-total-length"), int(h["warc-segment-number"])
                        yield _common(h) | {
                            "origin": h.get("warc-segment-origin-id", h["warc-record-id"]),
                            "number": number, "total": int(total) if total else None, "block": block,
                            "record_type": h["warc-type"] if number == 1 else None}
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    for frame in _frames(rows(), columns):
        yield frame.astype({"total": "Int64"})


def join_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: the ordered segments of an origin to its decoded record."""
    def rows():
        for batch in batches:
            for r in batch.itertuples(index=False):
                parts = [p["block"] for p in r.parts]
                lost = {"payload": None, "payload_digest": r.claimed if r.record_type == "revisit" else None}
                if [p["number"] for p in r.parts] != list(range(1, len(parts) + 1)):
                    found = lost | {"problem": "segments are missing or repeated"}
                elif pd.isna(r.total) or sum(map(len, parts)) != r.total:
                    found = lost | {"problem": "the total length differs"}
                else:
                    found = _decoded(r.record_type, parts, r.claimed)
                yield {
                    "row": r.row, "id": r.id, "url": r.url, "record_type": r.record_type, "refers_to": r.refers_to} | found
    return _frames(rows(), [c.split()[0] for c in DECODED.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in ``folder``.

    ``row`` (place of the record in the written table), ``id``, ``url``, ``record_type``, ``refers_to``
    (id of the response that a revisit repeats), ``payload`` (null for revisits), ``payload_digest`` (of
    revisits the one they state) and ``problem``: null, or why a payload cannot be had or isn't the one its record claims.  No archives, no rows.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    if spark.read.format("binaryFile").load(folder).limit(1).isEmpty():
        return spark.createDataFrame([], DECODED)
    segments = files.mapInPandas(read_segments, SEGMENTS).groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("total", "row", "id", "url", "claimed", "record_type", "refers_to")],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    return files.mapInPandas(read_whole, DECODED).unionByName(segments.mapInPandas(join_segments, DECODED))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Length and digest of the full payload of every record; a revisit's are those of the response it repeats."""
    # Stored without the payloads, so that the archives are read once.
    own = cut_lineage(records.select(
        "row", "id", "url", "record_type", "refers_to", "payload_digest", "problem",
        F.octet_length("payload").cast("long").alias("payload_bytes")))
    responses = own.where("record_type = 'response'")
    return responses.unionByName(
        own.where("record_type = 'revisit'").drop("payload_bytes").join(
            responses.groupBy(F.col("id").alias("refers_to"), "payload_digest").agg(
                F.max("payload_bytes").alias("payload_bytes")),
            ["refers_to", "payload_digest"], "left"))


SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
groups AS (SELECT hex, max(page_id) AS origin FROM hashed GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(1 +
    ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM hashed JOIN groups USING (hex)"""


@query("op10_warc", SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "archives")
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return resolve_revisits(read_archives(spark, folder)).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
