"""WARC archives of pages: written in segments, read back by reassembly.

Writing: pages of equal payload are found by SHA-256, the one with the largest page_id
becomes the response record, the others revisit it. A response is an HTTP message with
chunked transfer framing; where it is longer than ``segment_bytes`` it is cut into
a first record and continuation records that name it as their origin. Archives are
gzip files written by Spark's text sink, whose line separator is the blank line pair
between records; a file holds at most ``FILE_RECORDS`` records, so its size is bounded.

Reading: archives are parsed by their length fields, so a payload may hold anything.
Continuation records are sent to one task per origin identifier, ordered by segment
number, checked against the total length in the last one, and joined; then the chunked
framing is decoded. Records of one segment are decoded where they are read.

Defined cases: a null html is an empty payload; a null page_id has no field for it and
counts as the smallest; of rows equal in page_id and payload one is the response and
the others revisit it; white space in a url is percent-encoded; a record that lacks
a segment, has one twice or differs from its total length or digest is not ``complete``
and has no payload; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import BATCH_BYTES, folder, written
from statwarden.operators.skew import lookup

VERSION, END = b"WARC/1.1", b"\r\n\r\n"
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32 << 10, 8 << 10, 4096
# Copies of one payload beyond which its response is sent to all tasks; see ``lookup``.
HOT_COPIES = 1000
PAGE_FIELD = "X-Page-Id"


# ---------------------------------------------------------------- writing


def payload() -> Column:
    return F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))


def record_id(page_id: Column, digest: Column, copy: Column) -> Column:
    """A URN of the shape of a UUID, from page, payload and number of the copy."""
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), F.hex(digest), copy.cast("string")), 256)
    cuts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page and payload: how many copies it has, whether it holds the response, and which record revisits name."""
    digests = pages.select("page_id", F.unhex(F.sha2(payload(), 256)).alias("digest"), F.unhex(F.sha1(payload())).alias("sha1"), F.length(payload()).cast("long").alias("size"))
    known = written(digests.groupBy("page_id", "digest", "sha1", "size").agg(F.count(F.lit(1)).alias("copies")), "warc-digests")
    # a payload on one page only has no group to look up
    shared = known.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("pages"))
    shared = shared.where("pages > 1").select("digest", "keep", F.lit(True).alias("is_shared"))
    found = lookup(known, shared, ["digest"], ["page_id"], hot_rows=HOT_COPIES)
    small = F.col("size") < least_bytes
    keep = F.when(F.col("is_shared"), F.col("keep")).otherwise(F.col("page_id"))
    holds = F.col("page_id").eqNullSafe(keep)
    return found.select(
        "page_id", "digest", "sha1", "size",
        F.when(small, F.col("copies")).when(holds, 1).otherwise(0).cast("long").alias("responses"),
        F.when(small, 0).when(holds, F.col("copies") - 1).otherwise(F.col("copies")).cast("long").alias("revisits"),
        keep.alias("keep"),
    )


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The logical records, payloads with responses only."""
    plan = written(planned(pages, least_bytes), "warc-plan")

    def copies(first: Column, number: Column) -> Column:
        return F.when(number > 0, F.sequence(first, first + number - 1)).otherwise(F.array().cast("array<bigint>"))

    one = F.lit(1).cast("long")
    # one key without nulls, so that grouping and join share one shuffle of the payloads
    key = F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex("digest")), 256)).alias("key")
    held = pages.select("url", "html", "page_id", F.unhex(F.sha2(payload(), 256)).alias("digest"))
    held = held.select(key, "url", "html").groupBy("key").agg(F.min("url").alias("url"), F.first("html").alias("html"))
    whole = held.join(plan.where("responses > 0").select(key, "page_id", "digest", "sha1", "responses"), "key")
    responses = whole.withColumn("copy", F.explode(copies(one, F.col("responses")))).select(
        F.lit("response").alias("type"), record_id(F.col("page_id"), F.col("digest"), F.col("copy")).alias("record_id"), "page_id", "url",
        "sha1", payload().alias("payload"), F.lit(None).cast("string").alias("refers_to_id"),
    )
    again = plan.where("revisits > 0").withColumn("copy", F.explode(copies(F.col("responses") + 1, F.col("revisits"))))
    revisits = again.select(
        F.lit("revisit").alias("type"), record_id(F.col("page_id"), F.col("digest"), F.col("copy")).alias("record_id"), "page_id", F.lit(None).cast("string").alias("url"),
        "sha1", F.lit(None).cast("binary").alias("payload"), record_id(F.col("keep"), F.col("digest"), one).alias("refers_to_id"),
    )
    return responses.unionByName(revisits)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body with chunked transfer framing."""
    pieces = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*pieces, b"0\r\n\r\n"])


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def segments(row: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A logical record as one record, or as a first one and its continuations."""
    own = row["record_id"]
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), (PAGE_FIELD, row["page_id"])]
    digest = ("WARC-Payload-Digest", "sha1:" + b32encode(row["sha1"]).decode())
    url = ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe="".join(map(chr, range(33, 127)))))
    http = ("Content-Type", "application/http; msgtype=response")
    if row["type"] == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, profile, ("WARC-Refers-To", row["refers_to_id"])], b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = ("WARC-Segment-Number", 1 if len(cut) > 1 else None)
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, url, digest, number, http], cut[0])
    for k, part in enumerate(cut[1:], 2):
        name = f"{own[:-1]}:{k}>"
        total = ("WARC-Segment-Total-Length", len(block) if k == len(cut) else None)
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), common[0], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), total], part)


def write(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Logical records as archives in ``path``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for one in segments(row, segment_bytes):
                    some.append(one)
                    size += len(one)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])
                        some, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])

    text = rows.mapInArrow(cut, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


# ---------------------------------------------------------------- reading


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Records of an archive: header fields by lower-case name, and the block."""
    if content[:2] == b"\x1f\x8b":
        members = []
        while content:
            member = zlib.decompressobj(31)
            members.append(member.decompress(content))
            content = member.unused_data
        content = b"".join(members)
    at, whole = 0, memoryview(content)
    while at < len(content):
        head_end = content.index(END, at)
        first, *lines = content[at:head_end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.decode().strip().lower(): value.decode().strip() for name, _, value in (line.partition(b":") for line in lines)}
        start = head_end + len(END)
        end = start + int(fields["content-length"])
        if content[end : end + len(END)] != END:
            raise ValueError(f"record at byte {at} does not end at its length")
        yield fields, whole[start:end]
        at = end + len(END)


CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")


def body(message: bytes) -> bytes:
    """Body of an HTTP message, its chunked framing decoded; raises ValueError where it is broken."""
    head, found, rest = message.partition(END)
    if not found:
        raise ValueError("no end of the header")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked", head):
        return rest
    parts, at = [], 0
    while True:
        size = CHUNK_SIZE.match(rest, at)
        if not size:
            raise ValueError("no chunk size")
        length, start = int(size[1], 16), size.end()
        if not length:
            return b"".join(parts)
        if rest[start + length : start + length + 2] != b"\r\n":
            raise ValueError("a chunk does not end at its size")
        parts.append(rest[start : start + length])
        at = start + length + 2


def decoded(parts: list[tuple[int, int | None, bytes]], digest: str | None) -> bytes | None:
    """Payload of the segments (number, total length, block) of one record, or None where they are not whole."""
    blocks = [b for _, _, b in parts]
    if [n for n, _, _ in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != sum(map(len, blocks)):
        return None
    try:
        found = body(b"".join(blocks))
    except ValueError:
        return None
    return found if digest is None or digest == sha1_name(found) else None


def sha1_name(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


PARTS = "origin string, number int, total long, type string, page_id long, url string, refers_to_id string, digest string, block binary"
READ = "record_id string, record_type string, page_id long, url string, refers_to_id string, segments int, complete boolean, payload_bytes long, payload_digest string"


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def _grouped(rows: Iterator[tuple], schema: str, size_at: int | None) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded in rows and bytes."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 200 + (len(row[size_at]) if size_at is not None and row[size_at] else 0)
        if size >= BATCH_BYTES:
            yield _arrow(schema, some)
            some, size = [], 0
    yield _arrow(schema, some)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per logical record of the archives in ``path``: its fields, whether it is complete, and its payload."""
    archives = spark.read.format("binaryFile").load(path).select("content")
    schema = READ + (", payload binary" if with_payload else "")

    def fields_of(f: dict[str, str]) -> tuple:
        page = f.get(PAGE_FIELD.lower())
        return f["warc-type"], None if page is None else int(page), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest")

    def found(origin: str, kind: str, page_id, url, refers, digest, parts: list) -> tuple:
        data = decoded(parts, digest) if kind != "revisit" else None
        own = sha1_name(data) if data is not None else digest if kind == "revisit" else None
        complete = kind == "revisit" or data is not None
        row = (origin, kind, page_id, url, refers, len(parts), complete, None if data is None else len(data), own and own.removeprefix("sha1:"))
        return (*row, data) if with_payload else row

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for f, block in parsed(content.as_py()):
                        if "warc-segment-number" not in f:
                            yield found(f["warc-record-id"], *fields_of(f), [(1, len(block), bytes(block))])

        return _grouped(rows(), schema, 9 if with_payload else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for f, block in parsed(content.as_py()):
                        if "warc-segment-number" in f:
                            total = f.get("warc-segment-total-length")
                            number = int(f["warc-segment-number"])
                            origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                            yield (origin, number, None if total is None else int(total), *fields_of(f), bytes(block))

        return _grouped(rows(), PARTS, 8)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            origin, parts, first = None, [], None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["origin"] != origin:
                        if parts:
                            yield found(origin, *first, parts)
                        origin, parts, first = row["origin"], [], ("continuation", None, None, None, None)
                    parts.append((row["number"], row["total"], row["block"]))
                    if row["type"] != "continuation":
                        first = tuple(row[c] for c in ("type", "page_id", "url", "refers_to_id", "digest"))
            if parts:
                yield found(origin, *first, parts)

        return _grouped(rows(), schema, 9 if with_payload else None)

    single = archives.mapInArrow(whole, schema)
    parts = archives.mapInArrow(cut, PARTS).repartition("origin").sortWithinPartitions("origin", "number")
    return single.unionByName(parts.mapInArrow(joined, schema))


def resolved(read_back: DataFrame) -> DataFrame:
    """The contract's row per page: revisits take payload size and page from the response they name."""
    page = ["page_id", "record_id"]
    kept = read_back.where("record_type <> 'revisit'")
    responses = kept.select(*page, "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "segments", "complete")
    named = kept.select(F.col("record_id").alias("refers_to_id"), "payload_bytes", F.col("payload_digest").alias("held_digest"), F.col("page_id").alias("refers_to"), F.col("complete").alias("held"))
    revisits = read_back.where("record_type = 'revisit'").select(*page, "payload_digest", "record_type", "refers_to_id", "segments")
    found = lookup(revisits, named, ["refers_to_id"], ["record_id"], hot_rows=HOT_COPIES)
    complete = F.coalesce(F.col("held") & (F.col("held_digest") == F.col("payload_digest")), F.lit(False))
    again = found.select(*page, "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", complete.alias("complete"))
    return responses.unionByName(again).drop("record_id")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS rn, max(page_id) OVER (PARTITION BY payload) AS keep FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN keep END AS refers_to
FROM r
"""


@query("op11_warc_segments", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    write(records(table(spark, sf_dir, "pages")), path)
    return resolved(written(read(spark, path, with_payload=False), "warc-read")).drop("segments", "complete")
