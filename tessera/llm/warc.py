"""WARC archives: written with an index, read back through the index.

The index has one row per record: file, offset, length, URL, digest.  Readers
start from it: selected records are sorted by offset, neighbouring byte ranges
are joined into one read of at most RANGE_BYTES, and each record is cut out of
its range.  Archives are gzip members, one per record, in the folder given by
the caller; they are reached through ``pyarrow.fs``, so the folder can be any
file system of a URI that Arrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, partitions, runs

#: One read covers at most so many bytes (or one longer record).
RANGE_BYTES = 4 << 20
#: Bytes between two selected records that are read along rather than skipped.
GAP_BYTES = 64 << 10
_SPACE = uuid.UUID("6b0f4a52-1f0e-4c1f-9d51-6f0c5a3d2b11")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, payload_bytes long, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}')}>"


def revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: null for responses,
    else the largest page_id with an equal payload.

    Only digests are grouped, with partial counts; payloads are not compared
    across the network.  Of repeated page_ids with one payload the first by
    URL is the response.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.select("page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("sha1"))
    top = keyed.groupBy("sha1").agg(F.count("*").alias("n"), F.max(F.struct("page_id", F.hash("url").alias("tie"))).alias("top")).where("n > 1")
    # Rows of repeated payloads only, a few bytes each; a hot digest is a skewed join, which AQE splits.
    again = keyed.join(top.select("sha1", F.col("top.page_id").alias("response")), "sha1")
    again = again.groupBy("page_id", "sha1").agg(F.max("response").alias("response"), F.count("*").alias("rows"), F.min_by("url", F.coalesce("url", F.lit(""))).alias("first_url"))
    key = F.coalesce("page_id", F.lit(-(1 << 63))).alias("key")
    known = again.select(key, "sha1", "response", "first_url", "rows")
    # Dealt by the keys of the join, which adds no exchange of its own; rows of one page and payload meet.
    out = base.select("*", key, F.sha1(F.encode("html", "UTF-8")).alias("sha1")).repartition(partitions(pages.sparkSession), "key", "sha1")
    out = out.join(known, ["key", "sha1"], "left")
    lead = F.col("page_id").eqNullSafe(F.col("response")) & F.col("url").eqNullSafe(F.col("first_url"))
    return out.select("page_id", "url", "html", F.when(F.col("rows").isNotNull() & ~lead, F.col("response")).alias("refers_to"), (F.col("rows").isNotNull() & lead & (F.col("rows") > 1)).alias("tied"))


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> tuple[bytes, str, str]:
    """One record with its digest and type."""
    sha = digest(payload)
    kind = "response" if refers_to is None else "revisit"
    clean = " ".join((url or "").split())
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_urn(page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if refers_to is None:
        body = _HTTP + payload
    else:
        body = _HTTP
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Page", str(refers_to)),
            ("WARC-Payload-Length", str(len(payload))),
        ]
    fields += [("WARC-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _head(fields) + body + b"\r\n\r\n", sha, kind


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, raw[at + 4 : at + 4 + int(fields["Content-Length"])]


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write archives of ``pages`` below ``folder`` and return their index.

    Each task attempt writes a file of its own name; the index, which is cut
    from its lineage, names only those of attempts that succeeded.
    """

    def put(batches):
        store, root = fs.FileSystem.from_uri(folder)
        name, out, at, seen, index = f"{uuid.uuid4().hex}.warc.gz", None, 0, set(), []
        for batch in runs(batches, "html", 4 << 20):
            rows = []
            for page_id, url, html, refers, tied in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = html.encode()
                if tied:  # repeated rows of one page and payload meet in one partition
                    key = (page_id, url, len(payload), zlib.crc32(payload))
                    refers = page_id if key in seen else None
                    seen.add(key)
                raw, sha, kind = record(page_id, url, payload, refers, date)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = press.compress(raw) + press.flush()
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                rows.append((page_id, url, f"{root}/{name}", at, len(raw), sha, kind, len(payload), refers))
                at += len(raw)
            index.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "payload_bytes", "refers_to"],
                )
            )
        if out is not None:
            out.close()  # the index of a file is given out once the file is whole
        yield from index

    return cut_lineage(revisits(pages).mapInArrow(put, _INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects, parsed from the archives.

    Rows are dealt by file and stretch of RANGE_BYTES, so that one hot or
    large file is read by many tasks.  A payload whose digest differs from the
    index raises an error.
    """

    def get(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "payload_digest")), strict=True))
            out, k = [], 0
            while k < len(rows):
                file, start = rows[k][0], rows[k][1]
                end, j = start + rows[k][2], k + 1
                while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= RANGE_BYTES:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                with store.open_input_file(file) as f:
                    data = f.read_at(end - start, start)
                for _, offset, length, expected in rows[k:j]:
                    fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    page = fields["WARC-Page-ID"]
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if response else None
                    if sha != expected or response and digest(payload) != sha:
                        raise ValueError(f"damaged record at {offset} of {file}")
                    out.append((int(page) if page else None, len(payload) if response else int(fields["WARC-Payload-Length"]), sha, fields["WARC-Type"], None if response else int(fields["WARC-Refers-To-Page"])))
                k = j
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    stretch = F.expr(f"offset div {RANGE_BYTES}L")
    dealt = index.select("file", "offset", "length", "payload_digest").repartition(partitions(index.sparkSession), F.col("file"), stretch)
    dealt = dealt.sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(get, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives below ``folder`` and read every record back.

    Null html is the empty payload.  Equal payloads are kept once, with the
    largest page_id; the others are revisits.  Null page_ids, null URLs,
    repeated rows and an empty table are handled; other columns are ignored.
    """
    return read(write(pages, folder), folder)
