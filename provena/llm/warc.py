"""WARC archives: writing with deduplication and segments, reading, and reassembly.

Spark's text sink writes the archives: each row is a record without its closing CRLF CRLF,
and that closing is the sink's line separator. So files are committed as any Spark output, in
the shared folder, and a lost executor's files are written again. Archives are read with
binaryFile; ARCHIVE_BYTES bounds a file. Payloads go in HTTP responses with chunked transfer
framing; a block longer than a segment continues in continuation records, which are grouped by
origin, ordered, checked against the total length, and decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm import batches, scratch

CRLF = b"\r\n"
END = CRLF * 2
#: Bytes of a record's block, of a chunk of the transfer framing, and of an archive file, about.
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
ARCHIVE_BYTES = 16 << 20

#: Begins the part of a record id that tells records of one page_id apart.
MARK = ";sha1="
RECORD = "record_id string, type string, segment int, origin string, total_length long, refers_to string, digest string, block binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: eight groups of five hex digits, four letters each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, damage raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is shorter or longer than its size line says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing CRLF CRLF."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def response_records(record_id: str, uri: str, payload: bytes, digest: str, segment_bytes: int) -> Iterator[bytes]:
    """A response, in segments if its block is longer than one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + chunked(payload)
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    cuts = range(0, max(1, len(block)), segment_bytes)
    for n, at in enumerate(cuts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>")]
        if n > 1:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if len(cuts) > 1:
            own.append(("WARC-Segment-Number", str(n)))
        if len(cuts) > 1 and n == len(cuts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(own + common, block[at : at + segment_bytes])


def revisit_record(record_id: str, uri: str, refers_to: str, digest: str, length: int) -> bytes:
    """A revisit: the response's headers only, with the length of the payload it doesn't repeat."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z")]
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    return record([*headers, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], block)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by the lengths that records state."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        if archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at byte {at}")
        end = archive.index(END, at)
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if archive[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {at} is not closed where its length says")
        yield headers, archive[start:stop]
        at = stop + 4


def write_archive(records: DataFrame, column: str, path: str, mean_bytes: float) -> None:
    """Write a string column of records as gzipped .warc text, in files of about ARCHIVE_BYTES before compression.

    The records stay in the partitions that they are in: no shuffle only for the files' sizes.
    """
    most = max(1, int(ARCHIVE_BYTES / max(1.0, mean_bytes)))
    records.select(F.col(column).alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below a path: RECORD columns, segments not yet joined."""
    batches.bound(spark)

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda v: v.strip("<>") if v else None
        for part in parts:
            for content in part["content"]:
                rows, held = [], 0
                for h, block in parse(bytes(content)):
                    total = h.get("warc-segment-total-length")
                    rows.append((clean(h["warc-record-id"]), h["warc-type"], int(h["warc-segment-number"]) if "warc-segment-number" in h else None, clean(h.get("warc-segment-origin-id")), int(total) if total else None, clean(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    held += len(block)
                    if held > batches.BATCH_BYTES // 4:
                        yield pd.DataFrame(rows, columns=names).astype({"total_length": "Int64", "segment": "Int32"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"total_length": "Int64", "segment": "Int32"})

    names = [f.split()[0] for f in RECORD.split(", ")]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: continuations joined to their origin, in order, with the length verified.

    Records without a segment number are whole and pass without a shuffle. ``problem`` (string, null if none) says what
    is wrong with a record whose segments are missing, repeated or of another total length; its
    block is then null.
    """
    key = F.coalesce("origin", "record_id")
    parts = records.where("segment is not null")
    grouped = parts.groupBy(key.alias("record_id")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"),
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("type", "refers_to", "digest")],
    )

    @F.pandas_udf("struct<block:binary,problem:string>")
    def joined(numbers: pd.Series, blocks: pd.Series, totals: pd.Series) -> pd.DataFrame:
        rows = []
        for ns, bs, total in zip(numbers, blocks, totals, strict=True):
            block = b"".join(bytes(b) for b in bs)
            if list(ns) != list(range(1, len(ns) + 1)):
                rows.append((None, "segments are missing or repeated"))
            elif pd.isna(total) or len(block) != int(total):
                rows.append((None, "the total length differs"))
            else:
                rows.append((block, None))
        return pd.DataFrame(rows, columns=["block", "problem"])

    whole = grouped.withColumn("j", joined(F.col("parts.segment"), F.col("parts.block"), F.col("total_length")))
    whole = whole.select("record_id", "type", "refers_to", "digest", "j.block", "j.problem")
    single = records.where("segment is null").select("record_id", "type", "refers_to", "digest", "block", F.lit(None).cast("string").alias("problem"))
    return single.unionByName(whole)


def payloads(records: DataFrame) -> DataFrame:
    """Add payload_bytes (long) and payload_digest: of the decoded payload, or of the one a revisit names.

    ``record_id`` and ``refers_to`` give the page's name without what makes an id unique in the
    archive; the whole ids are in ``full_id`` and ``full_refers_to``.
    A block whose digest or framing is wrong gets a ``problem`` and null values.
    """

    @F.pandas_udf("struct<bytes:bigint,digest:string,problem:string>")
    def decoded(kinds: pd.Series, blocks: pd.Series, stated: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, block, digest in zip(kinds, blocks, stated, strict=True):
            if block is None:
                rows.append((None, None, "no block"))
                continue
            head, _, body = bytes(block).partition(END)
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
            try:
                if kind == "revisit":
                    rows.append((int(fields[b"content-length"]), digest, None))
                    continue
                payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((len(payload), found, None) if found == digest else (None, None, "the digest differs"))
            except (ValueError, KeyError) as e:
                rows.append((None, None, f"bad block: {e}"))
        return pd.DataFrame(rows, columns=["bytes", "digest", "problem"]).astype({"bytes": "Int64"})

    out = records.withColumn("d", decoded("type", "block", "digest"))
    short = lambda c: F.regexp_replace(c, f"{MARK}.*$", "").alias(c)
    return out.select(short("record_id"), "type", short("refers_to"), F.col("record_id").alias("full_id"), F.col("refers_to").alias("full_refers_to"), F.col("d.bytes").alias("payload_bytes"), F.col("d.digest").alias("payload_digest"), F.coalesce("problem", "d.problem").alias("problem"))


def archive_pages(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per row of (page_id, url, html), deduplicated by payload, below ``path``.

    Null html is an empty payload, null urls ``urn:none``; line breaks in urls become spaces. Of
    rows with equal payloads the one with the smallest page_id (null after all numbers) is the
    response, others revisit it; repeated rows are records of their own. Ids hold the payload's
    digest and length, a revisit's its url's hash too, so rows that share a page_id, or have none,
    have ids of their own. Equal payloads are
    reduced before any shuffle to one copy a task, so a payload that a third of the rows share
    does not meet in one task as text. An empty table writes no record.
    """
    batches.bound(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\r\n]+", " ")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("length", F.length("payload").cast("long"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uri")).alias("least")
    responses = base.groupBy("digest", "length").agg(least, F.first("payload").alias("payload"))
    responses = responses.select("digest", "length", "least.page_id", "least.uri", "payload")
    chosen = base.groupBy("digest", "length").agg(least).select(F.col("digest").alias("d"), F.col("length").alias("l"), "least")
    rows = base.groupBy("page_id", "uri", "digest", "length").agg(F.count("*").alias("n"))
    rows = rows.join(chosen, (rows["digest"] == chosen["d"]) & (rows["length"] == chosen["l"]))
    first = F.col("page_id").eqNullSafe(F.col("least.page_id")) & (F.col("uri") == F.col("least.uri"))
    rows = rows.withColumn("again", F.when(first, F.col("n") - 1).otherwise(F.col("n"))).where("again > 0")
    revisits = rows.select("page_id", "uri", "digest", "length", F.col("least.page_id").alias("refers_to"), F.posexplode(F.sequence(F.lit(1).cast("long"), "again")).alias("i", "copy"))

    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))

    own = F.concat(F.lit(MARK), "digest", F.lit(";length="), F.col("length").cast("string"))

    def as_responses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [r for x in part.itertuples() for r in response_records(x.id, x.uri, bytes(x.payload), x.digest, segment_bytes)]
            yield pd.DataFrame({"record": out})

    def as_revisits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"record": [revisit_record(x.id, x.uri, x.to, x.digest, x.length) for x in part.itertuples()]})

    made = responses.select(F.concat(name("page_id"), own).alias("id"), "uri", "payload", "digest").mapInPandas(as_responses, "record binary")
    seen = revisits.select(F.concat(name("page_id"), F.lit(":r"), F.col("copy").cast("string"), own, F.lit(";url="), F.hex(F.xxhash64("uri"))).alias("id"), "uri", F.concat(name("refers_to"), own).alias("to"), "digest", "length").mapInPandas(as_revisits, "record binary")
    mean = base.agg(F.avg("length").alias("b")).first()["b"] or 0.0
    write_archive(made.unionByName(seen).select(F.col("record").cast("string").alias("record")), "record", path, mean + 1024)


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, read back, reassembled and decoded."""
    path = scratch.new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    out = payloads(reassemble(read_archive(spark, path)))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("long")
    return out.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"), "problem",
    )


QUERIES = {"op2_warc_segments": op2_warc_segments}
ORACLE_SQL: dict[str, str] = {}
