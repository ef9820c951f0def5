"""WARC archives: written with an index of offset, length, URL and digest, and read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import NO_ID, join_small, join_unique, materialize, shared_dir

LEAST_BYTES = 100
#: Byte ranges closer than this are read at once, up to MOST_READ.
GAP = 64 * 1024
MOST_READ = 8 << 20
ROLL = 256 << 20


def open_store(path: str):
    """(file system, path in it) of a folder's URI; a bare path is local."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def record(kind: str, url: str, ident: str, refers: str | None, digest: str, payload: bytes) -> bytes:
    """A WARC/1.1 record; a revisit has no block, and names the record and digest it refers to."""
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record; raises ValueError where it is malformed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    return fields, rest[:n]


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every page.

    Of pages with equal payloads of at least 100 bytes the rows with the smallest page_id are responses and the others revisits; smaller payloads,
    and payloads of null ids alone, are responses.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    # Equal payloads are found by their digests alone; whole payloads meet them by page, so that copies of one page are dealt evenly.
    slim = materialize(pages.where(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest"))
    many = materialize(slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1 AND refers_to IS NOT NULL").drop("_n"))
    again = join_unique(slim, many, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = materialize(again.select(F.coalesce("page_id", F.lit(NO_ID)).alias("_id"), "payload_digest", "refers_to").distinct())
    pages = pages.withColumn("_id", F.coalesce("page_id", F.lit(NO_ID)))
    pages = join_small(pages, again, ["_id", "payload_digest"], "left").drop("_id")
    return pages.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes gzip-member-per-record archives and returns the index: file, offset, length, page_id, url, payload_digest, record_type, refers_to.

    Each task writes files of its own name. The index is the commit: a file of a lost or repeated task is in no index row and is never
    read. pages: as from classified().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page, url, payload, digest, kind, refers in zip(*(b.column(k).to_pylist() for k in range(6))):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    z = gzip.compress(record(kind, url or "", str(page), str(refers), digest, payload.encode()), 1, mtime=0)
                    out.write(z)
                    rows.append((name, at, len(z)))
                    at += len(z)
                cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                cols += [b.column(0), b.column(1), b.column(3), b.column(4), b.column(5)]
                yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "length", "page_id", "url", "payload_digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    cols = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    schema = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
    return materialize(pages.select(*cols).mapInArrow(run, schema))


def ranges(rows: list[tuple[int, int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Joins (offset, length, row) sorted by offset to reads (start, end, rows) over gaps of at most `gap` bytes; no read but of one record is over `most`."""
    own: list[tuple[int, int, int]] = []
    start = end = 0
    for x in rows:
        if own and (x[0] > end + gap or x[0] + x[1] - start > most):
            yield start, end, own
            own = []
        if not own:
            start, end = x[0], x[0]
        own.append(x)
        end = max(end, x[0] + x[1])
    if own:
        yield start, end, own


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The selected index rows with what their records say: payload_bytes, payload_digest, record_type, refers_to, url and payload.

    Rows are range-partitioned and sorted by file and offset, neighbours are read at once, and each record is parsed and its digest
    verified. A revisit's payload is null; its length and digest are those of the record it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, base = open_store(folder)
        for b in batches:
            files, offs, sizes = (b.column(k).to_pylist() for k in range(3))
            pages = b.column(3).to_pylist()
            out: list[tuple] = []
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                with store.open_input_file(f"{base}/{files[lo]}") as f:
                    for start, end, rows in ranges([(offs[k], sizes[k], k) for k in range(lo, hi)]):
                        f.seek(start)
                        raw = f.read(end - start)
                        for off, n, k in rows:
                            fields, block = parse(zlib.decompress(raw[off - start : off - start + n], 31))
                            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                            refers = fields.get("warc-refers-to", "")[len("<urn:page:") : -1]
                            if fields["warc-record-id"] != f"<urn:page:{pages[k]}>" or kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                                raise ValueError(f"record at {off} of {files[k]} is not what the index says")
                            out.append((pages[k], fields["warc-target-uri"], int(fields["x-payload-length"]), digest, kind, int(refers) if refers else None, block if kind == "response" else None))
                lo = hi
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length", "page_id").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Archives every page under the shared folder and reads records back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    wanted: a condition on the index (file, offset, length, page_id, url, payload_digest, record_type, refers_to); only the byte ranges of
    the records that it selects are read. All are if it is None.

    A null html is an empty payload and a null url about:blank. Null ids are archived as None and come back null. Repeated rows are archived each. Extra columns are
    not archived; an empty table gives no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(classified(pages), folder)
    return read_archives(index if wanted is None else index.where(wanted), folder)


def digest(pages: DataFrame) -> DataFrame:
    return warc(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
