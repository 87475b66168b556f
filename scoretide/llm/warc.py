"""WARC archives in the shared folder with a two-level capture index: written, indexed and read back by Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import over_batches, slices, stored, text_of
from scoretide.session import fresh_path

BLOCK = 2048  # index lines per compressed block
CAPTURED = "2024-01-01T00:00:00Z"  # WARC-Date where the caller gives none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the WARC standard

Place = tuple[str, bool, int]  # reversed-host key, whether there is an id, id


def url_key(url: str | None) -> str:
    """``http://b.a.org/p?q`` as ``org,a,b)/p?q``: pages of one host, and hosts of one domain, sort together."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host = ""
    if not host:
        return url.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def _record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Date: {date}", "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""),
            f"WARC-Payload-Digest: sha1:{digest}"]
    if original is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{original}>"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers of a record, its HTTP headers and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), "payload": payload}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = CAPTURED) -> DataFrame:
    """Write one gzip member per page and return the captures: key, id, file, offset, length.

    Of equal payloads of at least ``min_bytes`` bytes the page with the largest id is a response and the others revisit it;
    rows that share that largest id, and rows of a payload without any id, are responses. Every task writes its own
    file below the shared folder under a name of its own, so a task that runs again harms nothing: only
    files of finished tasks are named by the captures, which are a stored table.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    repeated = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(repeated.drop("n"), "digest", "left").select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("original"))
    folder = fresh_path(spark, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offset = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    found = []
                    for page, url, html, original in zip(*(part.column(c).to_pylist() for c in ("id", "url", "html", "original"))):
                        if out is None:
                            store.create_dir(path, recursive=True)
                            out = store.open_output_stream(name, compression=None)
                        payload = html.encode()
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(_record(page, url, payload, base32_sha1(payload), original, date)) + pack.flush()
                        out.write(member)
                        found.append((url_key(url), page, name, offset, len(member)))
                        offset += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["key", "id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(over_batches(rows, work, "key string, id long, file string, offset long, length long"), "captures")


class Index:
    """The top of the capture index: the range and directory place of each sorted file, one entry per Spark partition."""

    def __init__(self, folder: str, shards: list[tuple[Place, Place, str, int, int]]) -> None:
        self.folder, self.shards = folder, sorted(shards)


def _place(key: str, page: int | None) -> Place:
    return key, page is not None, page or 0


def _line(fields: str) -> tuple[Place, list[str]]:
    key, page, *rest = fields.split("\t")
    return _place(key, int(page) if page else None), rest


def build_index(captures: DataFrame, block: int = BLOCK) -> Index:
    """Sort the captures by key and id over ranges; each range becomes a file of compressed blocks of ``block`` lines,
    followed by its sparse directory: the first line's place, the offset and the length of each block."""
    spark = captures.sparkSession
    folder = fresh_path(spark, "capture-index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offset, directory, lines, last = f"{path}/{uuid.uuid4().hex}.cdx", None, 0, [], [], ""

        def flush() -> None:
            nonlocal out, offset, lines
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(name, compression=None)
            data = zlib.compress("\n".join(lines).encode())
            key, page = lines[0].split("\t")[:2]
            directory.append(f"{key}\t{page}\t{offset}\t{len(data)}")
            out.write(data)
            offset, lines = offset + len(data), []

        for batch in batches:
            for key, page, file, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                last = f"{key}\t{'' if page is None else page}"
                lines.append(f"{last}\t{file}\t{at}\t{length}")
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = zlib.compress("\n".join(directory).encode())
            out.write(data)
            out.close()
            first = "\t".join(directory[0].split("\t")[:2])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, name, offset, len(data))], names=["first", "last", "file", "offset", "length"])

    ranged = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("key", "id", "file", "offset", "length")
    shards = stored(over_batches(ranged, work, "first string, last string, file string, offset long, length long"), "shards")
    return Index(folder, [(_line(r.first)[0], _line(r.last)[0], r.file, r.offset, r.length) for r in shards.collect()])


class Reader:
    """Range reads below one folder, with a few files held open and a few blocks held unpacked."""

    def __init__(self, folder: str, files: int = 64, blocks: int = 8) -> None:
        self.store = fs.FileSystem.from_uri(folder)[0]
        self.files, self.blocks = OrderedDict(), OrderedDict()
        self.most_files, self.most_blocks = files, blocks

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            self.files[file] = self.store.open_input_file(file)
            if len(self.files) > self.most_files:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(file)
        return self.files[file].read_at(length, offset)

    def block(self, file: str, offset: int, length: int) -> tuple[list[Place], list[list[str]]]:
        at = (file, offset)
        if at not in self.blocks:
            lines = [_line(x) for x in zlib.decompress(self.read(file, offset, length)).decode().split("\n")]
            self.blocks[at] = [x[0] for x in lines], [x[1] for x in lines]
            if len(self.blocks) > self.most_blocks:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(at)
        return self.blocks[at]


def lookup(index: Index, reader: Reader, lasts: list[Place], want: Place) -> Iterator[tuple[str, int, int]]:
    """Captures of one place: binary search over the files, then in the directory, then in the blocks."""
    for shard in range(bisect_left(lasts, want), len(lasts)):
        first, _, file, offset, length = index.shards[shard]
        if first > want:
            return
        starts, blocks = reader.block(file, offset, length)
        for k in range(max(0, bisect_left(starts, want) - 1), bisect_right(starts, want)):
            places, lines = reader.block(file, *map(int, blocks[k]))
            for x in range(bisect_left(places, want), bisect_right(places, want)):
                yield lines[x][0], int(lines[x][1]), int(lines[x][2])


def read_captures(requests: DataFrame, index: Index, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of the requested pages: id, ``record_type``, ``refers_to``, ``payload_digest``, ``payload_bytes``, ``payload``.

    Requests are deduplicated, looked up in the order of the index, and the records read in the order of the archives,
    each by one range read, in tasks of about READ_BYTES. The digest of a response is checked against its payload. A revisit has no payload of its own;
    its HTTP header has the length. Pages that the index does not have give no row.
    """
    folder = index.folder

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], names=["id", "key"])

    spark = requests.sparkSession
    shards = spark.sparkContext.broadcast(index.shards)  # one entry per index file

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards.value)
        reader, lasts = Reader(folder), [s[1] for s in index.shards]
        for batch in batches:
            found = [x for i, k in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist()) for x in lookup(index, reader, lasts, _place(k, i))]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index.folder)
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse_record(zlib.decompress(reader.read(file, offset, length), 31))
                fields, payload = record["fields"], record["payload"]
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not have the digest of its record")
                page, original = (fields.get(n, "").removeprefix("<urn:page:").removesuffix(">") for n in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((int(page) if page else None, kind, int(original) if original else None, digest, int(record["http"]["Content-Length"]),
                             payload if kind == "response" else None))
                held += len(payload)
                if held > 8_000_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    rows = requests.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")).distinct()
    keyed = over_batches(rows, keys, "id long, key string").distinct()
    places = over_batches(keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), find, "file string, offset long, length long")
    # pointers are narrow and what they point to is not: the bytes of the records, not of the pointers, say into how many tasks they go
    places = stored(places, "places")
    n, size = places.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-size // READ_BYTES), min(spark.sparkContext.defaultParallelism, n // 1000))
    records = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return over_batches(records, fetch, READ).withColumnRenamed("id", id_col)


# Bytes of compressed records that one task reads.
READ_BYTES = 16 << 20
READ = "id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive the pages, index the captures and read every page back through the index: one row per page, as ``read_captures``.

    A NULL html is an empty payload, a NULL url an empty key. Rows that repeat both id and url are records of their own and all
    come back. An empty table gives an empty result. Other columns are not read.
    """
    index = build_index(write_archives(pages, id_col, url_col, html_col, min_bytes))
    return read_captures(pages, index, id_col, url_col)
