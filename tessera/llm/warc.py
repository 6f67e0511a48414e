"""WARC archives with a two-level capture index (operator 10).

Writing: every page is one gzip member of a WARC file, a response, or a revisit
where the same payload is stored with a larger page id.  Each capture's key is
its URL with the host reversed, then its page id.  Keys are range-sorted and cut
into compressed blocks of lines (level two); one directory row per block holds
the block's first key, file, offset and length (level one, sparse).

Reading: a key is searched in the directory, then in its block, both by
bisection; the line found names the archive, and one range read fetches the
record.  ``lines`` grows with the corpus so that the directory, which every
lookup task gets, keeps within ``DIRECTORY_ROWS`` rows.

Files are written by the tasks through Arrow's file systems into a folder of the
shared checkpoint folder, under a name of the task attempt; only rows of
attempts that succeeded name a file, so lost executors leave unused files and
nothing else.

Defined results: a null html is an empty payload; a null url has the key ``-``
(before the page id) and the target ``about:blank``; a null page id is written as ``-`` and read as null; repeated rows (same page id
and payload) are both responses; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.session import ensure_checkpoint_dir

LINES = 3000
DIRECTORY_ROWS = 500_000
FILE_BYTES = 1 << 30
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page string, file string, offset bigint, length bigint"


def reversed_host_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of a URL; the scheme, user, default port
    and fragment are left out, the host is lower-cased."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/?&=:;,.~-_%@+")
    if not host:
        return quote(url, safe="/?&=:;,.~-_%@+")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = quote(parts.path or "/", safe="/:;,.~-_%@+=&!$'()*")
    return f"{name}){path}" + (f"?{quote(parts.query, safe='/?:;,.~-_%@+=&!$()*')}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
            f"WARC-Target-URI: {quote(url, safe='/?&=:;,.~-_%@+#!$()*') if url else 'about:blank'}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; the payload of a response is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    kind, stored = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or digest_of(payload) != stored:
            raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    name = lambda x: None if x is None or x == "<urn:page:->" else int(x[10:-1])
    return {"page_id": name(field["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stored, "record_type": kind,
            "refers_to": name(field.get("WARC-Refers-To")), "url": field["WARC-Target-URI"], "payload": payload}


def _pack(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(folder: str):
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, html, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                page = "-" if page is None else str(page)
                data = _pack(record(page, url, (html or "").encode(), None if ref is None else str(ref)))
                out.write(data)
                rows.append((f"{reversed_host_key(url)} {page}", page, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _types)], names=_names)
        if out is not None:
            out.close()
    return run


_names = ["key", "page", "file", "offset", "length"]
_types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the WARC files; returns the written table of captures.  Of equal
    payloads of at least ``least`` bytes, the largest page id is the response."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    groups = (d.select("page_id", digest.alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n")).filter(F.col("_n") >= least)
              .groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    marked = d.withColumn("_sha", digest).join(cut(groups), "_sha", "left")
    ref = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return cut(marked.select("page_id", "url", "html", ref.alias("ref")).mapInArrow(_writer(folder), CAPTURE))


def _indexer(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx.gz"
        out, at, held = None, 0, []

        def flush(block):
            nonlocal out, at
            if out is None:
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            data = _pack("\n".join(f"{r[0]}\t{json.dumps(r[1:])}" for r in block).encode())
            out.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([v]) for v in (block[0][0], name, at, len(data), len(block))],
                                             names=["first", "file", "offset", "length", "n"])
            at += len(data)
            return row

        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= lines:
                yield flush(held[:lines])
                held = held[lines:]
        if held:
            yield flush(held)
        if out is not None:
            out.close()
    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the compressed blocks; returns the written sparse directory."""
    lines = max(LINES, -(-captures.count() // DIRECTORY_ROWS))
    ranged = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return cut(ranged.mapInArrow(_indexer(folder, lines), "first string, file string, offset bigint, length bigint, n bigint"))


def page_keys(pages: DataFrame) -> DataFrame:
    """Distinct index keys of ``(page_id, url)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{reversed_host_key(u)} {'-' if p is None else p}" for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], names=["key"])
    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "key string").distinct()


FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """One row per record that the index finds for the given ``key``s."""
    blocks = directory.orderBy("first", "file", "offset").toPandas()     # at most DIRECTORY_ROWS + one a partition
    first = blocks["first"].tolist()
    place = list(zip(blocks["file"], blocks["offset"].tolist(), blocks["length"].tolist()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, key = [], []
            for k in batch.column(0).to_pylist():
                for b in range(max(0, bisect_left(first, k) - 1), bisect_right(first, k)):
                    block.append(b), key.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(key, pa.string())], names=["block", "key"])

    def fetch(group: pa.Table) -> pa.Table:
        where, path = fs.FileSystem.from_uri(folder)
        file, offset, length = place[group["block"][0].as_py()]
        with where.open_input_file(f"{path}/{file}") as f:
            lines = zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")
        names = [x.partition("\t")[0] for x in lines]
        wanted = []
        for k in group["key"].to_pylist():
            for i in range(bisect_left(names, k), bisect_right(names, k)):
                wanted.append(json.loads(lines[i].partition("\t")[2])[1:])
        out, name, archive = [], None, None
        for file, offset, length in sorted(wanted):
            if file != name:
                if archive is not None:
                    archive.close()
                name, archive = file, where.open_input_file(f"{path}/{file}")
            got = parse(zlib.decompress(archive.read_at(length, offset), 31))
            out.append([got[n] for n in fields])
        if archive is not None:
            archive.close()
        columns = list(zip(*out)) if out else [()] * len(fields)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    routed = keys.mapInArrow(route, "block int, key string")
    return routed.groupBy("block").applyInArrow(fetch, FOUND)


def archive_folder(spark) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives and their index, then look every page up in them."""
    folder = archive_folder(pages.sparkSession)
    directory = build_index(write_archives(pages, folder, least), folder)
    return lookup(page_keys(pages), directory, folder)
