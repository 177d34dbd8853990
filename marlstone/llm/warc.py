"""WARC archives of pages, and a two-level capture index over them.

Writing: of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is written as a
response record, the others as revisit records that refer to it. Which is which is decided on digests alone. Every
record is a gzip member of its own that states its length (the extra field ``sl``), so that a reader can skip it.

Indexing: archives are streamed record by record; each capture becomes a line (reversed-host URL key, page_id, file,
offset, length). Lines are range-sorted by key and put into compressed blocks; an index file is its blocks and behind
them a sparse directory with the first and last key of each. One small table tells the first and last key of every file.

Reading: wanted keys are range-sorted too. A task binary-searches files, then directory, then the lines of the one block it
has open, so that each block is read once; the places found are sorted by file and offset, and only these byte
ranges are read from the archives. Lengths and digests of responses are computed anew and compared.

Files are written and read with pyarrow's file systems (local, HDFS, S3, GCS) in the shared folder; a file counts only once the
driver has committed it, so a task that runs twice leaves nothing behind that is read.

Defined cases: a null html is an empty payload; a null url has no target header and the key ""; line ends in a url are
percent-encoded; pages of one page_id and one payload are written each, and which of them is the response is not told
apart; a null page_id is a response and is found by its url; very long pages are one record, whole; an empty table writes
no archive and gives an empty result; columns of pages other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .common import cut, shared_dir, small_batches

#: Lines in an index block; compressed bytes after which an archive is closed.
BLOCK, ARCHIVE = 1000, 256_000_000
#: Bytes of repeated digests that may be sent to every task; with more, pages are shuffled by digest.
SENT = 64_000_000
#: Most bytes read at once, and the gap between two wanted ranges that is read over rather than skipped.
READ, GAP = 8_000_000, 65_536
_END = "\r\n"
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_FOUND = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def surt(url: str | None) -> str:
    """Key of a URL with its host reversed: com,example,m)/path?query; without scheme, user, www and fragment. No url: ""."""
    if url is None:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cutoff = min([k for k in (rest.find("/"), rest.find("?")) if k >= 0] or [len(rest)])
    host, path = rest[:cutoff].rsplit("@", 1)[-1].lower(), rest[cutoff:] or "/"
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    port = "" if port in ("", "80", "443") else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){path}"


def _plain(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, record_type, payload_bytes, sha1 (bytes), refers_to, html of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # A payload that very many pages share is one row here, and one that no other page has is none.
    again = cut(rows.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    small = again.count() * 40 <= SENT
    joined = rows.join(F.broadcast(again) if small else again, "sha1", "left")
    older = F.coalesce(F.col("page_id") < F.col("latest"), F.lit(False)) & (F.col("payload_bytes") >= least)
    return joined.select("page_id", "url", F.when(older, "revisit").otherwise("response").alias("record_type"), "payload_bytes", "sha1", F.when(older, F.col("latest")).alias("refers_to"), "html")


def _member(text: bytes) -> bytes:
    """A gzip member of text whose extra field states the lengths of member and text."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(text) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


def _record(row: dict) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = (head + (row["html"] if row["record_type"] == "response" else "")).encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_plain(row['url'])}")
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(row['sha1']).decode()}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return _member(_END.join(lines).encode() + body + b"\r\n\r\n")


class _Written(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Files of one folder; the driver lists those of successful tasks in its table of contents."""

    def __init__(self, path: str):
        self.path = path

    def _new(self, suffix: str) -> tuple[str, pa.NativeFile]:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        return name, where.open_output_stream(f"{root}/{name}", compression=None)

    def commit(self, messages) -> None:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/contents") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        where, root = filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{root}/{f[0]}")


class _Archives(_Writer):
    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.size = size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, out = [], None
        for batch in iterator:
            for k in range(0, len(batch), 200):
                for row in batch.slice(k, 200).to_pylist():
                    if out is None:
                        name, out = self._new(".warc.gz")
                        files.append([name])
                    out.write(_record(row))
                    if out.tell() >= self.size:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(files)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


class _Index(_Writer):
    """Sorted lines to blocks, the directory behind them, and its place in the last eight bytes."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held, out, name, directory = [], None, None, []

        def block(table: pa.Table) -> None:
            nonlocal out, name
            if out is None:
                name, out = self._new(".index")
            keys, ids = table.column("key"), table.column("pid")
            at, body = out.tell(), _packed(table)
            directory.append((keys[0].as_py(), ids[0].as_py(), keys[-1].as_py(), ids[-1].as_py(), at, len(body)))
            out.write(body)

        for batch in iterator:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK:
                table = pa.Table.from_batches(held)
                block(table.slice(0, BLOCK).combine_chunks())
                held = table.slice(BLOCK).to_batches()
        if sum(map(len, held)):
            block(pa.Table.from_batches(held).combine_chunks())
        if out is None:
            return _Written([])
        at = out.tell()
        out.write(_packed(pa.table(dict(zip(("first", "first_pid", "last", "last_pid", "offset", "length"), map(list, zip(*directory)))))))
        out.write(struct.pack("<q", at))
        out.close()
        return _Written([[name, *directory[0][:2], *directory[-1][2:4]]])


class Archive(DataSource):
    """Sink of records (kind ``archives``) or sorted lines (kind ``index``)."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_archive"

    def writer(self, schema, overwrite: bool):
        if self.options["kind"] == "index":
            return _Index(self.options["path"])
        return _Archives(self.options["path"], int(self.options["size"]))


def _save(df: DataFrame, path: str, kind: str, size: int = ARCHIVE) -> None:
    df.sparkSession.dataSource.register(Archive)
    with small_batches(df.sparkSession):
        df.write.format("marlstone_archive").option("kind", kind).option("size", str(size)).mode("append").save(path)


def _contents(path: str) -> list[list]:
    where, root = filesystem(path)
    with where.open_input_stream(f"{root}/contents") as f:
        return json.loads(f.read())


def write(pages: DataFrame, path: str, least: int = 0, archive: int = ARCHIVE) -> None:
    """Write the archives of pages to the folder path."""
    _save(records(pages, least), path, "archives", archive)


def parsed(text: bytes) -> tuple[dict, bytes]:
    """Headers and block of a record."""
    stop = text.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in text[:stop].decode().split(_END)[1:])
    return head, text[stop + 4 : stop + 4 + int(head["Content-Length"])]


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def members(f: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and headers of every record of an archive, read in pieces; bodies are skipped by their stated lengths."""
    at, size, held, base = 0, f.size(), b"", 0
    while at < size:
        if at + 24 > base + len(held):
            held, base = f.read_at(min(READ, size - at), at), at
        length = struct.unpack_from("<I", held, at - base + 16)[0]
        if at + length > base + len(held) and len(held) < length + (at - base):
            held, base = f.read_at(min(max(READ, length), size - at), at), at
        text, wanted = b"", 4096
        while b"\r\n\r\n" not in text:
            text = zlib.decompressobj(31).decompress(held[at - base : at - base + length], wanted)
            wanted *= 4
        yield at, length, text[: text.index(b"\r\n\r\n")]
        at += length


_LINE = "key string, pid long, file string, offset long, length long"


def _lines(path: str):
    def run(batches):
        where, root = filesystem(path)
        names = [x.split()[0] for x in _LINE.split(", ")]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with where.open_input_file(f"{root}/{name}") as f:
                    for offset, length, head in members(f):
                        fields = dict(x.split(": ", 1) for x in head.decode().split(_END)[1:])
                        number = _number(fields["WARC-Record-ID"])
                        rows.append((surt(fields.get("WARC-Target-URI")), _LOWEST if number is None else number, name, offset, length))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)

    return run


def index(spark: SparkSession, path: str, to: str) -> None:
    """Capture index of the archives under path, as files under to."""
    files = [(f[0],) for f in _contents(path)]
    rows = spark.createDataFrame(files, "file string").repartition(max(1, len(files)), "file")
    lines = cut(rows.mapInArrow(_lines(path), _LINE), "lines")
    _save(lines.repartitionByRange("key", "pid").sortWithinPartitions("key", "pid"), to, "index")


def _located(to: str):
    """Places in the archives of sorted wanted keys (key, low, high), by binary search in files, directories and blocks."""

    def run(batches):
        where, root = filesystem(to)
        files = sorted((tuple(f[1:3]), tuple(f[3:5]), f[0]) for f in _contents(to))
        firsts = [f[0] for f in files]
        held: dict[str, tuple] = {}  # the file that is open: directory and handle
        block: tuple = ()  # the block that is open: file, number, keys, places

        def directory(name: str):
            if name not in held:
                for _, _, _, handle in held.values():
                    handle.close()
                held.clear()
                f = where.open_input_file(f"{root}/{name}")
                size = f.size()
                at = struct.unpack("<q", f.read_at(8, size - 8))[0]
                d = _opened(f.read_at(size - 8 - at, at)).to_pydict()
                held[name] = (list(zip(d["first"], d["first_pid"])), list(zip(d["last"], d["last_pid"])), list(zip(d["offset"], d["length"])), f)
            return held[name]

        for batch in batches:
            out = []
            for key, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))):
                low, high = (key, low), (key, high)
                for k in range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high)):
                    if files[k][1] < low:
                        continue
                    begin, end, places, handle = directory(files[k][2])
                    for b in range(bisect.bisect_left(end, low), bisect.bisect_right(begin, high)):
                        if block[:2] != (k, b):
                            d = _opened(handle.read_at(places[b][1], places[b][0])).to_pydict()
                            block = (k, b, list(zip(d["key"], d["pid"])), list(zip(d["file"], d["offset"], d["length"])))
                        out += block[3][bisect.bisect_left(block[2], low) : bisect.bisect_right(block[2], high)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["file", "offset", "length"])

    return run


def _capture(text: bytes) -> tuple:
    head, block = parsed(text)
    payload = block.split(b"\r\n\r\n", 1)[1]
    size, digest, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response":
        if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its headers say")
    return _number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, size, digest, _number(head.get("WARC-Refers-To")), payload.decode() if kind == "response" else None


def _ranged(path: str):
    """Captures at sorted places (file, offset, length); neighbouring ranges are read in one go."""

    def run(batches):
        where, root = filesystem(path)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i, open_, f = 0, None, None
            while i < len(places):
                name, start, length = places[i]
                j, stop = i + 1, start + length
                while j < len(places) and places[j][0] == name and places[j][1] - stop <= GAP and places[j][1] + places[j][2] - start <= READ:
                    stop = places[j][1] + places[j][2]
                    j += 1
                if name != open_:
                    if f is not None:
                        f.close()
                    open_, f = name, where.open_input_file(f"{root}/{name}")
                body = f.read_at(stop - start, start)
                for k in range(i, j, 500):
                    found = [_capture(zlib.decompress(body[o - start : o - start + n], 31)) for _, o, n in places[k : min(k + 500, j)]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), _KINDS)], names)
                i = j
            if f is not None:
                f.close()

    return run


def _keyed(batches):
    for batch in batches:
        ids = batch.column("page_id").to_pylist()
        keys = [surt(None if u is None else _plain(u)) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], ["key", "page_id"])


def fetch(path: str, to: str, wanted: DataFrame) -> DataFrame:
    """Captures of wanted (url, and page_id if there is such a column), each once, read through the index under to.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, html (null for a revisit). Without a page_id
    column, all captures of a url are found.
    """
    exact = "page_id" in wanted.columns
    rows = wanted.select("url", (F.col("page_id") if exact else F.lit(None)).cast("long").alias("page_id"))
    low, high = F.coalesce("page_id", F.lit(_LOWEST)), F.coalesce("page_id", F.lit(_LOWEST if exact else _HIGHEST))
    keys = rows.mapInArrow(_keyed, "key string, page_id long").distinct().select("key", low.alias("low"), high.alias("high"))
    places = keys.repartitionByRange("key", "low").sortWithinPartitions("key", "low").mapInArrow(_located(to), "file string, offset long, length long")
    places = cut(places, "places")
    return places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_ranged(path), _FOUND)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, index them, and find every page again by url and page_id."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/marlstone/warc-{uuid.uuid4().hex}"
    write(pages, f"{base}/archives", least)
    index(spark, f"{base}/archives", f"{base}/index")
    return fetch(f"{base}/archives", f"{base}/index", pages.select("url", "page_id"))
