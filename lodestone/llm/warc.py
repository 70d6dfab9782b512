"""WARC archives: written with deduplicated payloads, read back, and indexed by an external merge of capture runs.

Each page becomes one record. Of the pages with equal payloads (of at least `least_bytes`), that with the smallest id
is a response and the others are revisits of it (identical-payload-digest); shorter payloads are all responses. Reading
an archive gives a run of captures, sorted by URL key and timestamp; runs are dealt out by ranges of these keys, and a
loser tree merges what each range has of each run, of bounded size. The result is in order within a range, and the ranges are in order.

A null html is an empty payload, a null URL an empty one. A page without an id comes after all that have one and is
referred to by none. Of equal rows with the smallest id each is a response, and ties in time go by id. A very long page is
one record, held whole. Input columns other than page_id, url and html aren't archived. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

#: An archive is closed when it is this large or has so many records; this bounds what reading one keeps of its index.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 200_000
#: Captures that one task merges, about; there are as many ranges as that takes.
MERGE_ROWS = 100_000
_EPOCH_SECONDS = 1_577_836_800
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, archive string, record_offset long, record_length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query, in lower case: pages of one site sort together."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (
        f"?{parts.query}" if parts.query else ""
    )


def capture_time(page_id: int | None) -> str:
    """The pages table has no time of capture: a second for each id, from a fixed day on."""
    import datetime

    return datetime.datetime.fromtimestamp(
        _EPOCH_SECONDS + (page_id or 0) % 1_000_000_000, datetime.timezone.utc
    ).strftime("%Y-%m-%dT%H:%M:%SZ")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, owner: int | None) -> bytes:
    """A whole record; owner is the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if owner is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(owner)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; lengths are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} has another length than it says")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, http, payload


def _files(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives into a folder that all executors share; returns the manifest (archive, records)."""
    spark = pages.sparkSession
    _shared.tune(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumn("_sum", F.sha1(F.encode("html", "UTF-8")))
    # digests found twice or more; Catalyst sends them to all tasks if they are few, else both sides meet by digest
    copies = rows.where(F.octet_length("html") >= least_bytes).groupBy("_sum").agg(
        F.min("page_id").alias("_owner"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1 AND _owner IS NOT NULL")
    rows = rows.join(_shared.staged(copies.drop("_n"), "warc-copies"), "_sum", "left")
    rows = rows.select(
        "page_id",
        "url",
        "html",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_owner")), F.col("_owner")).alias("_owner"),
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, path = _files(folder)
        store.create_dir(path, recursive=True)
        done: list[tuple[str, int]] = []
        out, n, size = None, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                name = f"part-{context.partitionId():06d}-{len(done):04d}.warc.gz"
                # a task that runs again writes the same file; the last complete one stands
                store.move(part, f"{path}/{name}")
                done.append((f"{folder.rstrip('/')}/{name}", n))
                out = None

        for batch in batches:
            for page_id, url, html, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    part = f"{path}/.{context.taskAttemptId()}-{len(done)}"
                    out, n, size = store.open_output_stream(part, compression=None), 0, 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), owner)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes or n >= ARCHIVE_RECORDS:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            ["archive", "records"],
        )

    return _shared.staged(rows.mapInArrow(archive, "archive string, records long"), "warc-manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member, one at a time."""
    at, data = 0, b""
    while data or (data := stream.read(chunk)):
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
            parts.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield at, used, b"".join(parts)
        at += used


def _capture(archive: str, offset: int, length: int, data: bytes) -> tuple:
    headers, http, payload = parse(data)
    kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(http.rpartition(b"Content-Length: ")[2].split(b"\r")[0])
    if kind == "response" and (digest(payload) != said or len(payload) != n):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't what its record says")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
    return (
        number(headers["WARC-Record-ID"]),
        n,
        said,
        kind,
        number(headers.get("WARC-Refers-To")),
        url_key(headers["WARC-Target-URI"]),
        headers["WARC-Date"],
        archive,
        offset,
        length,
    )


def _order(row: tuple) -> tuple:
    return row[5], row[6], row[0] is None, row[0] or 0, row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in CAPTURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], [x.split()[0] for x in CAPTURES.split(", ")])


def read(manifest: DataFrame) -> DataFrame:
    """The captures in the archives of a manifest; each archive gives one sorted run."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = _files(archive)
                with store.open_input_stream(path, compression=None) as stream:
                    rows = [_capture(archive, *m) for m in members(stream)]
                rows.sort(key=_order)
                for i in range(0, len(rows), 10_000):
                    yield _batch(rows[i : i + 10_000])

    return manifest.select("archive").repartition(_shared.n_partitions(spark)).mapInArrow(run, CAPTURES)


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs with a tree of losers: each inner node keeps the loser of its match, the winner goes on."""
    k = len(runs)
    heads: list[tuple | None] = [_order(r[0]) for r in runs]
    at = [0] * k
    losers = [-1] * max(1, k)

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    winner = 0
    for leaf in range(k):
        node, now = (leaf + k) // 2, leaf
        while node and losers[node] >= 0:
            if beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        if node:
            losers[node] = now
        else:
            winner = now
    while k and heads[winner] is not None:
        yield runs[winner][at[winner]]
        at[winner] += 1
        heads[winner] = _order(runs[winner][at[winner]]) if at[winner] < len(runs[winner]) else None
        node, now = (winner + k) // 2, winner
        while node:
            if beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        winner = now


def history(captures: DataFrame) -> DataFrame:
    """All captures by URL key and timestamp: ranges in order, and rows in order within each.

    The captures, which read() gives as sorted runs, are cut by ranges of about MERGE_ROWS each, so a task holds a bounded
    piece of every run, and the loser tree merges these pieces. The key goes on with the page id and the place of the
    record, so ranges also part the captures of one busy URL.
    """
    spark = captures.sparkSession
    runs = _shared.staged(captures, "warc-runs")
    ranges = max(_shared.n_partitions(spark), -(-runs.count() // MERGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a run come in ascending stretches; every stretch is a run of its own for the tree
        stretches: dict[str, list[list[tuple]]] = {}
        last: dict[str, tuple] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, key = stretches.setdefault(row[7], []), _order(row)
                if not own or last[row[7]] > key:
                    own.append([])
                last[row[7]] = key
                own[-1].append(row)
        rows = []
        for row in merged([s for own in stretches.values() for s in own]):
            rows.append(row)
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    keys = [F.col(c) for c in ("url_key", "timestamp", "page_id", "archive", "record_offset")]
    return runs.repartitionByRange(ranges, *keys).mapInArrow(merge, CAPTURES)


def archived(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read these back, and merge the captures into one history."""
    folder = _shared.work_path(pages.sparkSession, "warc")
    return history(read(write(pages, folder, least_bytes=least_bytes)))
