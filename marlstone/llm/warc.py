"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Archives are written by Spark's text writer: each row is a whole record (headers, block) and the line separator is the
two line ends that close a WARC record, so a gunzipped part file is a WARC 1.1 file. Long blocks are cut into segments:
a first record with WARC-Segment-Number 1 and continuation records that name it in WARC-Segment-Origin-ID, the last one
with the total length. HTTP blocks have chunked transfer framing.

Reading streams the files and parses them record by record, groups continuation records by the identifier of their origin, orders them
by segment number, verifies numbers and total length, and takes the transfer framing off.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of RFC 4122 for URLs
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK = 8192
SEGMENT = 32768
#: Payloads from this size on may be revisits.
REVISIT_BYTES = 1000
#: Records of one file at most: a task with more goes on in another one, so that files do not grow with the input's splits.
FILE_RECORDS = 20_000


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        parts.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def _identifier(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}:{digest}')}>"


def _clean(url: str | None) -> str:
    return "".join("%%%02X" % ord(c) if ord(c) < 33 or ord(c) == 127 else c for c in url or "") or "urn:none"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response with its continuations."""
    own = _identifier(page_id, digest)
    common = [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id), ("Payload-Length", len(payload))]
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _identifier(refers_to, digest)), ("Refers-To-Page-ID", refers_to)]
        return [_record([*head, ("Content-Type", "application/http;msgtype=response")], _HTTP)]
    block = _HTTP + chunked(payload)
    head = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [_record(head, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record([*head, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'{own}:{number}')}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url))]
        more += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)]
        out.append(_record(more, part))
    return out


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the rows of pages (page_id, digest, size) that repeat the payload of another page.

    Sizes and digests only are shuffled. Of equal payloads that of the largest page_id is the original.
    """
    large = pages.where(F.col("size") >= least)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return large.join(groups, "digest").where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = REVISIT_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzipped WARC files under path.

    Null html is an empty payload; a null page_id has no Page-ID header and is neither the original nor a revisit. Rows
    that repeat the largest page_id of a payload are each a response. Other columns are not read.
    """
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    again = materialise(revisits(base.select("page_id", "digest", F.octet_length("payload").alias("size")), least), "warc-revisits")
    rows = base.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for row in batch.itertuples(index=False):
                page, refers = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                out += records(page, row.url, bytes(row.payload), row.digest, refers, segment)
                size += len(row.payload)
                if size > 1 << 22:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            yield pd.DataFrame({"record": out})

    # a cast from binary keeps the bytes as they are; the writer copies them
    rows.mapInPandas(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of WARC files given in pieces; no more than a record and a piece is held."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def fill(n: int) -> bool:
        """Whether n bytes follow ``at``."""
        nonlocal at
        if len(held) - at < n:
            del held[:at]
            at = 0
            for p in pieces:
                held.extend(p)
                if len(held) >= n:
                    break
        return len(held) - at >= n

    while True:
        while fill(1) and held[at] in b"\r\n":
            at += 1
        while (end := held.find(_END, at)) < 0:
            if not fill(len(held) - at + 1):
                if held[at:].strip():
                    raise ValueError("a record ends in its headers")
                return
        first, *lines = held[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at, size = end + 4, int(headers["content-length"])
        if not fill(size):
            raise ValueError("a record ends in its block")
        yield headers, memoryview(held)[at : at + size].tobytes()
        at += size


_SCHEMA = "record_id string, kind string, page_id long, url string, digest string, payload_length long, refers_to long, origin string, segment int, total long, block binary"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _SCHEMA.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path: headers as columns, and the block.

    A gzipped file (.txt.gz) goes to one task, which reads it in the pieces between the separators of records, whatever its
    size; a plain one (.txt) is a single piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(x: str | None) -> int | None:
            return None if x is None else int(x)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        pieces = (p for b in batches for i in range(0, b.num_rows, 256) for p in b.column(0).slice(i, 256).to_pylist())
        rows, size = [], 0
        for h, block in parse(pieces):
            digest = h.get("warc-payload-digest", "").partition(":")[2] or None
            seg = number(h.get("warc-segment-number"))
            origin = h.get("warc-segment-origin-id") or (h["warc-record-id"] if seg is not None else None)
            rows.append((h["warc-record-id"], h["warc-type"], number(h.get("page-id")), h.get("warc-target-uri"), digest, number(h.get("payload-length")), number(h.get("refers-to-page-id")), origin, seg, number(h.get("warc-segment-total-length")), block))
            size += len(block)
            if size > 1 << 22 or len(rows) == 10_000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    zipped = spark.read.option("lineSep", _END.decode()).option("pathGlobFilter", "*.txt.gz").text(path).select(F.concat(F.col("value").cast("binary"), F.lit(_END)).alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.col("content").alias("piece"))
    return zipped.union(plain).mapInArrow(run, _SCHEMA)


def reassemble(found: DataFrame) -> DataFrame:
    """A row for each response and revisit of read_records(): its columns, payload binary, and state string.

    Continuations are grouped by origin, ordered by number and verified: state is ``whole``, ``no first segment``,
    ``segments missing``, ``wrong length`` or ``bad framing``; payload is null in all states but the first, and of
    revisits. A segment that is there twice counts once, but a response archived k times comes back k times. Each group
    is one payload, so no group grows with the input.
    """
    single = found.where("segment IS NULL AND kind <> 'continuation'").select("record_id", "kind", "page_id", "url", "digest", "payload_length", "refers_to", F.col("block").alias("body"), F.lit("whole").alias("state"))
    cut = found.where("segment IS NOT NULL OR kind = 'continuation'")
    # a segment once, whatever the number of copies
    once = cut.groupBy("origin", "segment").agg(F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"), F.first("block").alias("block"), *(F.first(c).alias(c) for c in ("kind", "page_id", "url", "digest", "payload_length", "refers_to")))
    first = F.col("segment") == 1
    joined = once.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(first, F.col("copies"))).alias("copies"),
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("kind", "page_id", "url", "digest", "payload_length", "refers_to")),
    )
    body = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["block"]))
    state = (
        F.when(F.col("copies").isNull(), "no first segment")
        .when(F.col("total").isNull() | (F.col("n") != F.col("last")), "segments missing")
        .when(F.octet_length("body") != F.col("total"), "wrong length")
        .otherwise("whole")
    )
    whole = joined.withColumn("body", body).withColumn("state", state).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    both = single.unionByName(whole.select(F.col("origin").alias("record_id"), "kind", "page_id", "url", "digest", "payload_length", "refers_to", "body", "state"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads, states = [], []
            for kind, body, state in zip(batch["kind"], batch["body"], batch["state"], strict=True):
                payload = None
                if state == "whole" and kind == "response":
                    head, _, rest = bytes(body).partition(_END)
                    try:
                        payload = dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                    except ValueError:
                        state = "bad framing"
                payloads.append(payload)
                states.append(state)
            yield batch.drop(columns="body").assign(payload=payloads, state=states)

    return both.mapInPandas(run, "record_id string, kind string, page_id long, url string, digest string, payload_length long, refers_to long, state string, payload binary")


def archived_pages(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, state of reassembled records.

    Sizes and digests of responses are taken from the payloads themselves; a payload that contradicts its header has
    the state ``wrong digest``. Revisits carry those of their headers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            has = batch["payload"].notna()
            digest = [hashlib.sha1(bytes(p)).hexdigest() if h else d for p, h, d in zip(batch["payload"], has, batch["digest"], strict=True)]
            size = [len(p) if h else n for p, h, n in zip(batch["payload"], has, batch["payload_length"], strict=True)]
            state = ["wrong digest" if h and d != e else s for h, d, e, s in zip(has, digest, batch["digest"], batch["state"], strict=True)]
            out = batch[["page_id"]].assign(payload_bytes=pd.array(size, "Int64"), payload_digest=digest, record_type=batch["kind"], refers_to=batch["refers_to"].astype("Int64"), state=state)
            yield out.astype({"page_id": "Int64"})

    return found.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, state string")
