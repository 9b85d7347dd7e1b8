"""Operator 2: WARC archives with segmented records, written and reassembled.

Writing: each page is an HTTP response with a chunked body. A block longer
than ``segment_bytes`` is split: the first record carries segment number 1,
continuation records name its id as WARC-Segment-Origin-ID, the last one
also the total length. Of pages with equal payloads of ``revisit_from``
bytes or more only one is stored (the largest page_id, then the largest
url); the others are revisit records that refer to it. Archives are plain
files of whole records in any folder Spark writes to, at most
``records_per_file`` records each.

Reading: archives are parsed record by record, segments are grouped by
origin id and ordered by segment number, their number, sizes and total
length are verified, the chunked framing is decoded, and the payload digest
is compared with the header's. Revisits take length and digest from the
record they refer to.

``status`` says what held: ok, incomplete (segments or total length),
framing, digest, or missing (the record referred to).

Defined cases: null html is an empty payload; a null page_id is a page of
its own kind (null last in choosing the response); repeated rows are stored
and returned each; control characters of a url are percent-encoded; an empty
table gives no archives and no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import new_folder, written

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """Transfer framing: each chunk behind its length in hex, closed by an empty one."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[k:k + size]), payload[k:k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body (extensions and trailers are passed over)."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk of another length")
        parts.append(body[at:at + size])
        at += size + 2


def record(headers: dict, block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None),
             b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def records(page_id, url: str, payload: bytes, digest: str, record_id: str, refers_to: str | None,
            segment_bytes: int, chunk_bytes: int, date: str) -> list[bytes]:
    """All records of one page."""
    safe = "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    common = {"WARC-Date": date, "WARC-Target-URI": safe, "X-Page-ID": page_id,
              "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    own = f"<urn:uuid:{record_id}>"
    if refers_to:
        return [record({"WARC-Type": "revisit", "WARC-Record-ID": own, "WARC-Refers-To": f"<urn:uuid:{refers_to}>",
                        "WARC-Profile": PROFILE, **common}, HTTP)]
    block = HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record({"WARC-Type": "response", "WARC-Record-ID": own, **common}, block)]
    parts = [block[k:k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [record({"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Segment-Number": 1, **common}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        segment_id = hashlib.md5(f"{record_id}/{n}".encode()).hexdigest()
        out.append(record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{segment_id}>",
                           "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n, "WARC-Date": date,
                           "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}, part))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 8192, chunk_bytes: int = 4000,
                   revisit_from: int = 1000, records_per_file: int = 2000, compression: str = "gzip",
                   date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Write every row of ``pages`` as WARC records into files under ``path``."""
    page = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload"))
    record_id = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest", "url"))
    page = page.withColumn("record_id", record_id)
    long = F.octet_length("payload") >= revisit_from
    # null ids come last: a struct orders nulls first, and the largest is taken
    known = (page.filter(long).select("digest", "page_id", "url", "record_id").groupBy("digest")
             .agg(F.max(F.struct("page_id", "url", "record_id")).alias("r"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("digest").alias("_digest"), F.col("r.record_id").alias("_response")))
    # as a table its size is known before the join: a small one is broadcast and no payload is shuffled
    known = written(known, "responses")
    both = page.join(known, long & (F.col("digest") == F.col("_digest")), "left")
    refers = F.when(F.col("_response") != F.col("record_id"), F.col("_response"))

    @arrow_udf("array<binary>")
    def made(page_id: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, own: pa.Array, refers: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (page_id, url, payload, digest, own, refers)))
        return pa.array([records(*r, segment_bytes, chunk_bytes, date) for r in rows], pa.list_(pa.binary()))

    out = both.select(F.explode(made("page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")),
                                     "digest", "record_id", refers)).alias("record"))
    # the text sink writes the bytes as they are, and the two closing line ends behind each record
    (out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path))


def parsed(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers in lower case, block) of each record of an archive, gzipped (in one or many members) or not."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head = data.index(END, at)
        lines = data[at:head].split(b"\r\n")[1:]
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        start = head + len(END)
        end = start + int(headers["content-length"])
        yield headers, data[start:end]
        at = end


SCHEMA = ("type string, record_id string, page_id bigint, url string, digest string, refers_to string, origin_id string,"
          " segment int, total_length bigint, whole boolean, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``."""
    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parsed(content.as_py()):
                    number = lambda k: int(h[k]) if k in h else None
                    rows.append({"type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "page_id": number("x-page-id"),
                                 "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "sha1:")[5:],
                                 "refers_to": h.get("warc-refers-to"),
                                 "origin_id": h.get("warc-segment-origin-id", h.get("warc-record-id")),
                                 "segment": number("warc-segment-number"), "total_length": number("warc-segment-total-length"),
                                 "whole": len(block) == int(h["content-length"]), "block": block})
                kinds = [("type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                         ("digest", pa.string()), ("refers_to", pa.string()), ("origin_id", pa.string()),
                         ("segment", pa.int32()), ("total_length", pa.int64()), ("whole", pa.bool_()), ("block", pa.binary())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, SCHEMA)


def reassembled(found: DataFrame) -> DataFrame:
    """(record_id, page_id, url, digest, segments, block, complete) per response; a repeated record is returned as often."""
    responses = found.filter("type IN ('response', 'continuation')")
    one = responses.filter("segment IS NULL").select(
        "record_id", "page_id", "url", "digest", F.lit(1).alias("segments"), "block", F.col("whole").alias("complete"))
    # equal segments of repeated records are counted, others of one number can't both be right
    # dealt by origin once, for both groupings: blocks are shuffled one time
    segment = (responses.filter("segment IS NOT NULL").repartition("origin_id").groupBy("origin_id", "segment")
               .agg(F.first("block").alias("block"), F.count_distinct(F.md5("block")).alias("kinds"), F.min("whole").alias("whole"),
                    F.count("*").alias("copies"), F.max("total_length").alias("total_length"),
                    F.max(F.struct("page_id", "url", "digest")).alias("head")))
    first = F.col("segment") == 1
    many = (segment.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"), F.sum(F.octet_length("block")).alias("length"),
        F.max("segment").alias("last"), F.min((F.col("kinds") == 1) & F.col("whole")).alias("sound"),
        F.max(F.when(first, F.col("copies"))).alias("copies"), F.max(F.when(first, F.col("head"))).alias("head")))
    complete = (F.col("sound") & (F.size("parts") == F.col("last")) & F.col("head").isNotNull()
                & F.col("total_length").isNotNull() & (F.col("length") == F.col("total_length")))
    whole = many.select(
        F.col("origin_id").alias("record_id"), "head.page_id", "head.url", "head.digest", F.size("parts").alias("segments"),
        joined_blocks()(F.transform("parts", lambda p: p["block"])).alias("block"),
        F.coalesce(complete, F.lit(False)).alias("complete"), F.coalesce("copies", F.lit(1)).alias("copies"))
    whole = whole.withColumn("_k", F.explode(F.sequence(F.lit(1), "copies"))).drop("_k", "copies")
    return one.unionByName(whole)


def joined_blocks():
    @arrow_udf("binary")
    def join(parts: pa.Array) -> pa.Array:
        return pa.array([b"".join(p) for p in parts.to_pylist()], pa.binary())
    return join


def payloads(responses: DataFrame) -> DataFrame:
    """``reassembled`` with the decoded payload and status in place of the block."""
    @arrow_udf("struct<payload:binary,framed:boolean>")
    def decoded(blocks: pa.Array) -> pa.Array:
        out, framed = [], []
        for b in blocks.to_pylist():
            head, _, body = b.partition(END)
            try:
                out.append(unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
                framed.append(True)
            except ValueError:
                out.append(None)
                framed.append(False)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(framed, pa.bool_())], ["payload", "framed"])

    rows = responses.withColumn("d", decoded("block")).withColumn("payload", F.col("d.payload"))
    status = (F.when(~F.col("complete"), "incomplete").when(~F.col("d.framed"), "framing")
              .when(F.sha1("payload") != F.col("digest"), "digest").otherwise("ok"))
    return rows.select("record_id", "page_id", "url", "segments", "payload", status.alias("status"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, segments, status."""
    # parsed once: responses, segments and revisits read the records from a table, without Python beside their shuffles
    found = written(read_records(spark, path), "records")
    response = payloads(reassembled(found)).select(
        "record_id", "page_id", "url", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"), "segments", "status")
    response = written(response, "payloads")
    target = response.groupBy(F.col("record_id").alias("_id")).agg(
        F.first(F.struct("page_id", "payload_bytes", "payload_digest", "status")).alias("t"))
    revisit = (found.filter("type = 'revisit'").select("record_id", "page_id", "url", "refers_to", "digest")
               .join(target, F.col("refers_to") == F.col("_id"), "left")
               .select("record_id", "page_id", "url", "t.payload_bytes", "t.payload_digest",
                       F.lit("revisit").alias("record_type"), F.col("t.page_id").alias("refers_to"), F.lit(1).alias("segments"),
                       F.when(F.col("_id").isNull(), "missing").when(F.col("t.payload_digest") != F.col("digest"), "digest")
                       .otherwise(F.col("t.status")).alias("status")))
    return response.unionByName(revisit).drop("record_id")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all pages to archives (in the shared folder unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, **options)
    return read_pages(spark, path)
