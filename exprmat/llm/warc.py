"""WARC archives, index first: every record's offset, length, URL and digest are written to an index
table; readers select records there, sort them by file and offset, and read coalesced byte ranges.

``write_warc`` finds the pages with equal payloads by SHA-1 digest (one row per repeated digest,
combined map-side), then each task writes its pages as one or more ``.warc.gz`` files, a gzip member
per record. Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest id
is a response and the others revisit it. ``read_warc`` takes index rows (any selection) and returns
their records.

Cases: a null html is an empty payload; a null URL is written as an empty target; rows with equal page
ids and equal payloads are each written (all but the first in a revisit of that id, by the smallest
id rule: a row whose id equals the response's id is itself a response); a row with a null id is a
revisit if its payload has a row with an id, else a response; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from exprmat.llm.common import fresh_folder, pin, small_side

#: A file is closed when it has this many bytes; ranges with gaps of at most GAP bytes are read as one of up to READ.
FILE_BYTES = 32 << 20
GAP = 64 << 10
READ = 8 << 20

INDEX = ("page_id long, file string, offset long, length long, url string, payload_digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _line(value: str | None) -> str:
    """A header value: line breaks and other control characters would end the header."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or c in '%"' else c for c in value or "")


def _unline(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def format_record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is None:
        head.append("X-No-Target: 1")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (empty for a revisit, which carries only the HTTP header)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages``; returns the index, written as a table."""
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body")))
    first = pin(rows.where(F.octet_length("body") >= min_bytes).groupBy("sha")
                .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                .where("n > 1 and first_id is not null").select("sha", "first_id"), "warc-firsts")
    joined = rows.join(small_side(first, first.count()), "sha", "left").select(
        "page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        # a retried task writes files of its own; only files of the attempt that succeeded are in the index
        out, name, at = None, "", 0
        for b in batches:
            found = []
            for i, url, body, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                member = _member(format_record(i, url, body, digest, ref))
                out.write(member)
                found.append((i, f"{uri}/{name}", at, len(member), url, digest, len(body),
                              "response" if ref is None else "revisit", ref))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=_NAMES
            ) if found else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)
        if out is not None:
            out.close()

    return pin(joined.mapInArrow(write, INDEX), "warc-index")


_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.int64() if c.endswith(" long") else pa.string() for c in INDEX.split(", ")]


def read_warc(index: DataFrame, with_payload: bool = True, gap: int = GAP, read: int = READ) -> DataFrame:
    """The records of the index rows: sorted by file and offset, neighbouring ranges read as one,
    each record parsed and its payload checked against its digest."""
    spark = index.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Runs of records of one file that lie within ``gap`` bytes of each other."""
        name, run = None, []
        for b in batches:
            for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (f != name or o - sum(run[-1]) > gap or o + n - run[0][0] > read):
                    yield name, run
                    run = []
                name = f
                run.append((o, n))
        if run:
            yield name, run

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for name, run in ranges(batches):
            if name != opened:
                fs, path = pafs.FileSystem.from_uri(name)
                opened, source = name, fs.open_input_file(path)
            begin = run[0][0]
            data = source.read_at(sum(run[-1]) - begin, begin)
            found = []
            for o, n in run:
                f, body = parse_record(zlib.decompress(data[o - begin:o - begin + n], 31))
                digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"{posixpath.basename(name)} at {o}: payload does not match its digest")
                found.append((
                    _id(f["WARC-Record-ID"]), None if "X-No-Target" in f else _unline(f["WARC-Target-URI"]),
                    int(f["X-Payload-Length"]), digest, kind,
                    _id(f["WARC-Refers-To"]) if kind == "revisit" else None,
                    body if with_payload and kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                                             names=[c.split()[0] for c in RECORD.split(", ")])

    return wanted.mapInArrow(fetch, RECORD)
