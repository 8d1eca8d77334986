"""WARC archives: written by Spark's text writer, read back, segments put together.

A record is one row whose line end is the record end, so archives go wherever
Spark can write. A block longer than a segment becomes a first segment and
continuation records. Reading cuts archives by Content-Length, groups
segments by the origin's record id, orders them by number, compares their length
with the stated total and only then decodes the chunked transfer framing. Rows
with equal payloads meet on their digest: one row per digest is joined back, and
adaptive execution splits a digest that fills a large part of the rows.

Nulls: null html is an empty payload, a null url is left out of the headers, a
null page_id counts as the smallest. Equal rows are records of their own; of
rows that share payload and largest page_id every one is a response.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import quoted

CRLF, GZIP = b"\r\n", b"\x1f\x8b"
RECORD_END = "\r\n\r\n"
#: Bytes of a block in one segment, and of body in one transfer chunk.
SEGMENT_BYTES, CHUNK_BYTES = 8192, 2048
#: Records in an archive file; with the segment size this bounds what a reader holds.
RECORDS_PER_FILE = 4096
#: Payloads below are never revisits.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size:at + size + 2] != CRLF:
            raise ValueError("a chunk is cut off")
        out.append(data[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the record end, which the writer adds."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(own: str, url: str | None, payload: bytes, digest: str, refers: str | None, date: str, segment: int) -> list[bytes]:
    head = [("WARC-Record-ID", own), ("WARC-Date", date), *([("WARC-Target-URI", " ".join(url.split()))] if url else []), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *head], block)]
    cuts = range(0, len(block), segment)
    out = []
    for k, at in enumerate(cuts, 1):
        number = [("WARC-Segment-Number", str(k))]
        if k == len(cuts):
            number.append(("WARC-Segment-Total-Length", str(len(block))))
        if k == 1:
            out.append(record([("WARC-Type", "response"), *head, *number], block[:segment]))
        else:
            out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", date),
                               ("WARC-Segment-Origin-ID", own), *number], block[at:at + segment]))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, in order: fields by lower-case name, block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(fields["content-length"])
        if begin + size > len(data):
            raise ValueError("a record is cut off")
        yield fields, data[begin:begin + size]
        at = begin + size + 4


# ---- writing


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, digest, own and refers (record ids): what each page's record says."""
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("page_id"), F.col(quoted(url)).cast("string").alias("url"),
                        F.coalesce(F.col(quoted(html)).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
                        F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = (rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("d"), F.col("size").alias("s"))
              .agg(F.max(F.struct("page_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    both = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    again = F.col("top").isNotNull() & ~F.col("top.page_id").eqNullSafe(F.col("page_id"))
    name = lambda i, r: F.concat(F.lit("<urn:x-page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), r.cast("string"), F.lit(">"))
    return both.select("page_id", "url", "payload", "digest", name(F.col("page_id"), F.col("row")).alias("own"),
                       F.when(again, name(F.col("top.page_id"), F.col("top.row"))).alias("refers"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z",
          segment: int = SEGMENT_BYTES) -> None:
    """Archives of one record per page below `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[bytes] = []
                for r in batch.slice(at, 256).to_pylist():
                    out += records_of(r["own"], r["url"], r["payload"], r["digest"], r["refers"], date, segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = with_revisits(pages, page_id, url, html).mapInArrow(run, "record binary")
    (rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(folder))


# ---- reading

RECORD = "record_id string, type string, uri string, refers string, digest string, origin string, number int, total bigint, block binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives, gzipped or not; segments as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                data = content.as_py()
                for f, block in parse(gzip.decompress(data) if data[:2] == GZIP else data):
                    own = f["warc-record-id"]
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((own, f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"),
                                 f.get("warc-segment-origin-id", own), number and int(number), total and int(total), block))
                    if len(rows) == 512:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per whole record; `error` says what is wrong with its segments, and then `block` is null."""
    whole = records.where("number IS NULL").select("record_id", "type", "uri", "refers", "digest", "block", F.lit(None).cast("string").alias("error"))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    parts = records.where("number IS NOT NULL").groupBy("origin").agg(
        *[first(c) for c in ("type", "uri", "refers", "digest")], F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    long = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    error = (F.when(F.col("parts")["number"] != F.sequence(F.lit(1), F.size("parts")), "segments are missing or repeated")
             .when(F.col("total").isNull(), "no last segment").when(F.col("total") != long, "the length differs from the stated total"))
    # The blocks are joined in the Arrow step that decodes them.
    joined = parts.select(F.col("origin").alias("record_id"), "type", "uri", "refers", "digest", F.col("parts")["block"].alias("blocks"), error.alias("error"))
    return whole.withColumn("blocks", F.array("block")).drop("block").select(*joined.columns).unionByName(joined)


PAYLOAD = "record_id string, record_type string, uri string, refers string, payload_bytes bigint, payload_digest string, payload binary, error string"


def payloads(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Decode reassembled records: payload with its size and SHA-1; for a revisit what its headers state of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in PAYLOAD.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    size = digest = body = None
                    error, stated = r["error"], (r["digest"] or "").removeprefix("sha1:") or None
                    try:
                        if error is None:
                            head, _, rest = b"".join(r["blocks"]).partition(b"\r\n\r\n")
                            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                            if r["type"] == "revisit":
                                size, digest = int(fields[b"content-length"]), stated
                            else:
                                body = unchunked(rest) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else rest
                                size, digest = len(body), hashlib.sha1(body).hexdigest()
                                error = None if stated in (None, digest) else "the payload differs from its digest"
                    except (ValueError, KeyError) as e:
                        error = f"broken block: {e}"
                    rows.append((r["record_id"], r["type"], r["uri"], r["refers"], size, digest, body if with_payload else None, error))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return reassemble(records).mapInArrow(run, PAYLOAD)


def page_of(record_id) -> object:
    """The page_id in a record id of `write`; null if it was null."""
    return F.regexp_extract(record_id, "^<urn:x-page:(-?[0-9]+):", 1).try_cast("long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m"""
