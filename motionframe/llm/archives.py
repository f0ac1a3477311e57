"""WARC archives: writing records with segments, and putting segments together again.

The project has no web records, so this works on any table of pages with a key, an
address and a payload text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from motionframe.session import scratch_dir, ship_package

SEGMENT_BYTES = 8 << 10     # block bytes per record; longer ones go on in continuation records
CHUNK_BYTES = 4 << 10       # chunk size of the transfer coding
REVISIT_BYTES = 100         # smaller payloads are always stored
PART_BYTES = 12 << 20       # payload per archive file; the number of files follows the input

# Fixed: names and line ends of the record format.
CRLF = b"\r\n"
RECORD_END = CRLF + CRLF
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"

_ADDRESS = re.compile(r"[\x00-\x20\x7f]")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[a:a + size]), payload[a:a + size]) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undoes chunked framing; raises ValueError where it is broken. Extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at:at + size])
        if len(parts[-1]) != size or body[at + size:at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        at += size + 2


def _record(kind: bytes, record_id: str, url: str, headers: list[bytes], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + DATE,
             b"WARC-Target-URI: " + url.encode(), *headers, b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def page_records(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None,
                 segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the two line ends that follow each."""
    url = _ADDRESS.sub("", url or "")
    seal = b"WARC-Payload-Digest: sha256:" + digest.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n" % len(payload)
    if refers_to is not None:
        return [_record(b"revisit", record_id, url, [seal, b"WARC-Profile: " + REVISIT_PROFILE,
                                                     b"WARC-Refers-To: <" + refers_to.encode() + b">",
                                                     b"Content-Type: application/http; msgtype=response"], http + CRLF)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = [seal, b"Content-Type: application/http; msgtype=response"]
    if len(block) <= segment:
        return [_record(b"response", record_id, url, kind, block)]
    out = []
    for n, at in enumerate(range(0, len(block), segment), 1):
        part = block[at:at + segment]
        if n == 1:
            out.append(_record(b"response", record_id, url, [*kind, b"WARC-Segment-Number: 1"], part))
            continue
        headers = [b"WARC-Segment-Origin-ID: <" + record_id.encode() + b">", b"WARC-Segment-Number: %d" % n]
        if at + segment >= len(block):
            headers.append(b"WARC-Segment-Total-Length: %d" % len(block))
        out.append(_record(b"continuation", f"{record_id}:{n}", url, headers, part))
    return out


def parse_records(data: bytes):
    """(headers, block) of each record of an archive; raises ValueError where framing is broken."""
    at = 0
    while at < len(data):
        stop = data.index(RECORD_END, at)
        first, *lines = data[at:stop].split(CRLF)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(b":") for line in lines))
        begin = stop + len(RECORD_END)
        end = begin + int(headers[b"content-length"])
        if data[end:end + len(RECORD_END)] != RECORD_END:
            raise ValueError(f"record at byte {at} does not end as it should")
        yield headers, data[begin:end]
        at = end + len(RECORD_END)


def _name(key: Column) -> Column:
    """A key as part of a record's id: no colons, spaces or line ends, and NULL apart from empty."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), F.url_encode(key.cast("string"))))


def _key_of(record_id: Column, kind) -> Column:
    name = F.split(record_id, ":")[2]
    return F.when(name != "", F.url_decode(F.substring(name, 2, 1 << 30))).cast(kind)


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
                   segment: int = SEGMENT_BYTES) -> None:
    """Writes one response or revisit record per page to gzip-compressed archive files.

    Of pages with equal payloads (SHA-256) of REVISIT_BYTES or more, the smallest key is
    the response and the others refer to it. Only rows without payloads are grouped by
    digest; payloads move once, by key and digest. A row is text to Spark's writer, which
    puts the two line ends behind each record, so files land wherever Spark can write.
    """
    spark = pages.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(payload), F.lit(""))
    name = _name(F.col(key))
    rows = pages.select(F.col(key).alias("k"), name.alias("name"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        text.alias("payload"), F.sha2(F.encode(text, "utf-8"), 256).alias("digest"))
    size = pages.agg(F.sum(F.octet_length(F.col(payload)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    narrow = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("k", "name", "digest")
    first = narrow.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(first, "digest").groupBy("name", "digest").agg(F.first("first").alias("first"))
    # payloads move here; the window and the join below find them in place
    rows = rows.repartition(parts, "name", "digest")
    turn = F.row_number().over(W.partitionBy("name", "digest").orderBy("url"))  # repeated keys get a number each
    rows = rows.withColumn("n", turn).join(again, ["name", "digest"], "left")
    is_first = F.col("first").isNull() | (F.col("k").eqNullSafe(F.col("first")) & (F.col("n") == 1))
    name = F.concat("name", F.lit(":"), F.substring("digest", 1, 16), F.lit(":"))
    rows = rows.select(
        F.concat(F.lit("urn:page:"), name, F.col("n").cast("string")).alias("id"), "url", "payload", "digest",
        F.when(~is_first, F.concat(F.lit("urn:page:"), _name(F.col("first")), F.lit(":"),
                                   F.substring("digest", 1, 16), F.lit(":1"))).alias("refers_to"))

    def tasks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                records = [r for row in zip(part["id"], part["url"], part["payload"], part["digest"], part["refers_to"])
                           for r in page_records(row[0], row[1], row[2].encode(), row[3], row[4], segment)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    out = rows.mapInArrow(tasks, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_HEADS = "id string, origin string, segment int, total long, kind string, refers_to string, digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archive files below a path, gzip or plain."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def tasks(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = _gunzip(data)
                rows = []
                for h, block in parse_records(data):
                    own = h[b"warc-record-id"].decode().strip("<>")
                    refers = h.get(b"warc-refers-to")
                    total = h.get(b"warc-segment-total-length")
                    rows.append((own, h.get(b"warc-segment-origin-id", own.encode()).decode().strip("<>"),
                                 int(h.get(b"warc-segment-number", 0)), int(total) if total else None,
                                 h[b"warc-type"].decode(), refers.decode().strip("<>") if refers else None,
                                 h.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), block))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(tasks, _HEADS)


def _gunzip(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _HEADS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole pages from records: (id, kind, refers_to, stated_digest, payload_bytes, payload_digest, fault).

    Segmented records are grouped by the identifier of their origin and ordered by
    segment number; numbers must run from 1 without a gap, and the last one's total must
    equal the length put together. The block's HTTP head is taken off and chunked framing
    decoded. A record that fails gets a `fault` and NULL results instead of ending the job.
    A group is one page, so its size is that of a page. A revisit has no payload: its
    digest and length are those that its record states.
    """
    ship_package(records.sparkSession)
    whole = records.where("segment = 0").select("id", "kind", "refers_to", F.col("digest").alias("stated_digest"), "block",
                                                F.lit(None).cast("string").alias("fault"))
    whole = whole.withColumn("blocks", F.array("block")).drop("block")
    parts = F.array_sort(F.collect_list(F.struct("segment", "total", "kind", "digest", "block")))
    joined = records.where("segment > 0").groupBy("origin").agg(parts.alias("s"))
    count = F.size("s")
    complete = ((F.element_at("s", 1)["segment"] == 1) & (F.element_at("s", -1)["segment"] == count)
                & (F.size(F.array_distinct(F.transform("s", lambda x: x["segment"]))) == count))
    joined = joined.select(
        F.col("origin").alias("id"), F.element_at("s", 1)["kind"].alias("kind"), F.lit(None).cast("string").alias("refers_to"),
        F.element_at("s", 1)["digest"].alias("stated_digest"), F.transform("s", lambda x: x["block"]).alias("blocks"),
        F.when(~complete, "segments missing or repeated")
        .when(F.element_at("s", -1)["total"].isNull(), "no total length")
        .when(F.element_at("s", -1)["total"] != F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"])),
              "total length differs").alias("fault"))
    names = ["id", "kind", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "fault"]
    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)

    def tasks(batches):
        for batch in batches:
            rows = batch.to_pydict()
            size, digest, fault = [], [], []
            for kind, stated, block, problem in zip(rows["kind"], rows["stated_digest"], rows["blocks"], rows["fault"]):
                n, d, block = None, None, b"".join(block)
                if problem is None:
                    try:
                        head, _, body = block.partition(RECORD_END)
                        if kind == "revisit":
                            n, d = int(re.search(rb"(?i)x-payload-length: *(\d+)", head)[1]), stated
                        else:
                            if re.search(rb"(?i)transfer-encoding: *chunked", head):
                                body = dechunked(body)
                            n, d = len(body), hashlib.sha256(body).hexdigest()
                            if stated and stated != d:
                                problem = "payload digest differs"
                    except (ValueError, TypeError):
                        problem = "broken framing"
                size.append(n)
                digest.append(d)
                fault.append(problem)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(size, pa.int64()), pa.array(digest, pa.string()),
                                              pa.array(fault, pa.string())], names)

    return whole.unionByName(joined).select("id", "kind", "refers_to", "stated_digest", "blocks", "fault").mapInArrow(tasks, schema)


def archive_round_trip(pages: DataFrame, path: str | None = None, *, key: str = "page_id", url: str = "url",
                       payload: str = "html", segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages to archives, reads them back and puts every page together again.

    Returns (key, payload_bytes, payload_digest, record_type, refers_to) per input row,
    all of it from the archives. NULL payloads are empty ones, NULL keys come back as
    NULL (such a page is never what others refer to, unless no key is known), repeated
    rows are pages of their own. Other columns are ignored. An empty table gives no rows.
    Any faulty record fails the job: what was just written must be whole.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "archives")
    kind = pages.schema[key].dataType
    write_archives(pages, path, key=key, url=url, payload=payload, segment=segment)
    found = reassemble(read_records(spark, path))
    ok = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat("id", F.lit(": "), "fault")).cast("string")).otherwise(F.col("id"))

    return found.select(_key_of(ok, kind).alias(key), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                        _key_of(F.col("refers_to"), kind).alias("refers_to"))
