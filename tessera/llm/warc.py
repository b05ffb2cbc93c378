"""WARC archives: a writer with revisit records, and a reader that salvages what it can of damaged files.

The writer gives each task's records to files of their own, one gzip member per record, under a name of the
partition; a file is written under a name of the attempt and then moved, so a task that is run again replaces its
own work. The reader walks a file record by record. Where a check fails (member, header, length, block or payload
digest), it searches on for the next gzip member or version line that starts a sound record, logs the bytes between
as a quarantined gap with the reason, and goes on from there.

Within a gzip member the same search runs over its decompressed bytes: sound records before and after a bad one are
given, and so are those before the place where a member breaks off; gaps inside are logged by their place in the
decompressed bytes (``inner``, ``inner_length``), a broken member as a gap of the file as well. A member is unpacked
as it is read, so memory holds a window and one record, however large the member.

Defined cases: null html is an empty payload; a null url leaves out the target; null page ids stay null, are never
referred to, and have record ids numbered within their file; repeated rows are records of their own, and all rows with
the largest id of their payload are responses; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch_rows, scratch, table, written
from tessera.operators.kept import dealt

ROLL_BYTES, WINDOW, LEVEL = 64 << 20, 1 << 18, 3
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
DATE = "1970-01-01T00:00:00Z"  # reruns make equal files
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "path string, kind string, offset long, length long, reason string, type string, uri string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, inner long, inner_length long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path there; driver and executors alike."""
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, unnamed: str = "none") -> bytes:
    """A response record, or a revisit record that refers to another page's response, as one gzip member; ``unnamed`` names a page without id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{unnamed if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def _write(root: str, roll: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where = filesystem(root)
        task = TaskContext.get()
        out, n, count, size = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{task.partitionId():06d}-{n:04d}.warc.gz"
            if at.get_file_info(f"{where}/{name}").type != pafs.FileType.NotFound:
                at.delete_file(f"{where}/{name}")  # an earlier attempt's; not every file system replaces it in a move
            at.move(f"{where}/.{task.taskAttemptId()}-{n}", f"{where}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    out, count, size = at.open_output_stream(f"{where}/.{task.taskAttemptId()}-{n}"), 0, 0
                data = record(page_id, url, html.encode(), refers_to, f"none-{task.partitionId()}-{n}-{count}")
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    yield close()
                    out, n = None, n + 1
        if out is not None:
            yield close()

    return run


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of at least ``least_bytes``, all but the largest id refer to it.

    Payload digests are grouped, never pages; only digests that occur twice are joined back."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("__sha1", F.sha1(F.col("html").cast("binary"))).withColumn("__bytes", F.octet_length("html"))
    many = rows.where(F.col("__bytes") >= least_bytes).groupBy("__sha1", "__bytes").agg(F.count("*").alias("__n"), F.max("page_id").alias("__first"))
    many = written(many.where("__n > 1"), "equal-payloads")
    joined = rows.join(many, ["__sha1", "__bytes"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("__first")), F.col("__first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, root: str, roll: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the folder ``root``; (path, records, bytes) of each file."""
    at, where = filesystem(root)
    at.create_dir(where, recursive=True)
    with batch_rows(pages.sparkSession):
        return written(with_references(pages, least_bytes).mapInArrow(_write(root, roll), "path string, records long, bytes long"), "archives")


# ---------------------------------------------------------------- reading


class Broken(Exception):
    """A check failed; the message is the reason."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, if it has one."""
        if "application/http" in self.headers.get("content-type", ""):
            _, found, body = self.block.partition(b"\r\n\r\n")
            return body if found else b""
        return self.block


class Source:
    """Bytes of a seekable file by place, through one buffered window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, WINDOW))
        return self.data[at - self.start : at - self.start + n]


class Unpacked:
    """Decompressed bytes of the gzip member at ``at``, by place, unpacked as they are asked for; ``forget`` drops what lies before a place.

    After the end, ``end`` is the place after the member, or ``broken`` says why there is none."""

    def __init__(self, source: Source, at: int):
        self.source, self.start, self.data, self.end, self.broken = source, 0, bytearray(), None, None
        self.unpack, self.crc = zlib.decompressobj(-15), 0  # without zlib's own check of the trailer, which would withhold the last bytes
        head = source.read(at, WINDOW)
        flags, self.place = head[3] if len(head) > 9 else 0, 10
        if flags & 4:
            self.place += 2 + int.from_bytes(head[10:12], "little")
        for flag in (8, 16):  # a name, a comment
            if flags & flag:
                self.place = head.find(b"\0", self.place) + 1 or len(head)
        self.place += at + (2 if flags & 2 else 0)

    def _add(self, out: bytes) -> None:
        self.data += out
        self.crc = zlib.crc32(out, self.crc)

    def _more(self, most: int) -> bool:
        if self.end is not None or self.broken:
            return False
        packed = self.unpack.unconsumed_tail
        if not packed:
            packed = self.source.read(self.place, WINDOW)
            self.place += len(packed)
        if not packed:
            self.broken = "gzip: member is cut short"
            return False
        before = self.unpack.copy()
        try:
            self._add(self.unpack.decompress(packed, most))
        except zlib.error as e:
            self.broken = f"gzip: {str(e)[:60]}"
            while most:  # what comes before the fault, in ever smaller steps
                step = before.copy()
                try:
                    out = step.decompress(packed, most)
                except zlib.error:
                    most //= 2
                    continue
                if not out:
                    break
                self._add(out)
                before, packed = step, step.unconsumed_tail
            return False
        if self.unpack.eof:
            at = self.place - len(self.unpack.unused_data)
            trailer = self.source.read(at, 8)
            if trailer != self.crc.to_bytes(4, "little") + (self.start + len(self.data) & 0xFFFFFFFF).to_bytes(4, "little"):
                self.broken = "gzip: member is cut short" if len(trailer) < 8 else "gzip: incorrect data check"
                return False
            self.end = at + 8
        return True

    def read(self, at: int, n: int) -> bytes:
        while self.start + len(self.data) < at + n and self._more(max(4096, min(at + n - self.start - len(self.data), WINDOW))):
            pass
        return bytes(self.data[at - self.start : at - self.start + n])

    def forget(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = max(self.start, at)


class Signatures:
    """The next place of each of some signatures, looked for only when passed."""

    def __init__(self, read: Callable[[int, int], bytes], *signatures: bytes):
        self.read, self.places = read, dict.fromkeys(signatures, -2)

    def after(self, at: int, forget: Callable[[int], None] = lambda at: None) -> int:
        """The first one at ``at`` or later, or -1."""
        for what, place in self.places.items():
            if place != -1 and place < at:
                self.places[what] = self._find(what, at, forget)
        return min((p for p in self.places.values() if p >= 0), default=-1)

    def _find(self, what: bytes, at: int, forget: Callable[[int], None]) -> int:
        while data := self.read(at, WINDOW):
            i = data.find(what)
            if i >= 0:
                return at + i
            if len(data) < WINDOW:
                return -1
            at += len(data) - len(what) + 1
            forget(at)
        return -1


def parse(read: Callable[[int, int], bytes], size: int | None, at: int) -> tuple[Record, int]:
    """The record at ``at`` of a run of bytes (of ``size``, if that is known) and the place after it. Raises Broken where a check fails."""
    if read(at, len(VERSION)) != VERSION:
        raise Broken("no version line")
    n = 4096
    while (end := (head := read(at, n)).find(b"\r\n\r\n")) < 0:
        if len(head) < n:
            raise Broken("header does not end")
        n *= 4
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0][5:6].isdigit() or any(":" not in x for x in lines[1:]):
        raise Broken("malformed header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Broken("no content length")
    start = at + end + 4
    stop = start + int(length)
    if size is not None and stop > size:
        raise Broken("block is cut short")
    if read(stop, 4) != b"\r\n\r\n":
        raise Broken("no end of record after the block")
    found = Record(headers, read(start, int(length)))
    for name, data in (("warc-block-digest", found.block), ("warc-payload-digest", None if headers.get("warc-type") == "revisit" else found.payload)):
        if data is not None and headers.get(name, "").startswith("sha1:") and headers[name][5:] != digest(data):
            raise Broken(f"{name[5:]} differs")
    return found, stop + 4


@dataclass
class Found:
    """A record, or a gap (``record`` None): its place and length in the file, and in its member's decompressed bytes where
    the member holds more than the one record. A record that shares its member has no length in the file."""

    place: int
    length: int | None
    record: Record | None
    reason: str | None = None
    inner: int | None = None
    inner_length: int | None = None


def inside(content: Unpacked, place: int) -> Iterator[Found]:
    """The records and the gaps of a member's decompressed bytes, in order."""
    at, lost, why = 0, None, None
    lines = Signatures(content.read, VERSION)
    while content.read(at, 1):
        try:
            one, end = parse(content.read, None, at)
        except Broken as e:
            lost, why = (at, str(e)) if lost is None else (lost, why)
            if at == 0 and not content.read(0, len(VERSION)).startswith(VERSION[: len(content.read(0, len(VERSION)))]) and content.end is None:
                break  # no archive: a stray signature, which is not worth unpacking
            at = lines.after(at + 1, content.forget)
            if at < 0:
                break
            continue
        if lost is not None:
            yield Found(place, None, None, why, lost, at - lost)
            lost = None
        yield Found(place, None, one, None, at, end - at)
        at = end
        content.forget(at)
    if lost is not None:
        yield Found(place, None, None, content.broken or why, lost, content.start + len(content.data) - lost)


def salvage(file, size: int) -> Iterator[Found]:
    """All records and all quarantined gaps, in file order."""
    source = Source(file, size)
    ahead = Signatures(lambda at, n: source.read(at, min(n, size - at)) if at < size else b"", MAGIC, VERSION)
    at, lost, why = 0, None, None  # lost: where the open gap began
    while 0 <= at < size:
        end, sound, held, reason = None, False, [], None
        if source.read(at, 3) == MAGIC:
            content = Unpacked(source, at)
            for item in inside(content, at):
                if item.record is not None and not sound:
                    sound = True
                    if lost is not None:
                        yield Found(lost, at - lost, None, why)
                        lost = None
                held.append(item)
                if sound and len(held) > 1:  # several: they share the member, and their inner places tell them apart
                    yield from held[:-1]
                    held = held[-1:]
            while content._more(WINDOW):  # the trailer's check
                content.forget(content.start + len(content.data))
            end, reason = content.end, content.broken or next((x.reason for x in held if x.reason), "member is empty")
            if sound:
                last = held[-1]
                if end is not None and last.record is not None and last.inner == 0:
                    last = Found(at, end - at, last.record)  # the member's only record
                yield last
            if end is not None and not sound:  # a whole member without a sound record
                lost, why, at = (at, reason, end) if lost is None else (lost, why, end)
                continue
        else:
            try:
                one, end = parse(source.read, size, at)
                if lost is not None:
                    yield Found(lost, at - lost, None, why)
                    lost = None
                yield Found(at, end - at, one)
            except Broken as e:
                reason = str(e)
        if end is not None:
            at = end
            continue
        lost, why = (at, reason) if lost is None else (lost, why)
        at = ahead.after(at + 1)
    if lost is not None:
        yield Found(lost, size - lost, None, why)


def _read(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, *[pa.int64()] * 3, pa.binary()][: len(names)]

    def rows(path: str) -> Iterator[tuple]:
        at, where = filesystem(path)
        with at.open_input_file(where) as file:
            for x in salvage(file, file.size()):
                if x.record is None:
                    yield path, "gap", x.place, x.length, x.reason, None, None, None, None, None, None, x.inner, x.inner_length, None
                    continue
                h, body = x.record.headers, x.record.payload
                own = h.get("warc-type") != "revisit"
                stated = x.record.block.split(b"\r\n\r\n")[0].lower().partition(b"content-length:")[2].split(b"\r\n")[0].strip()
                n = len(body) if own else int(stated) if stated.isdigit() else None
                sha1 = digest(body) if own else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                yield path, "record", x.place, x.length, None, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-record-id"), h.get("warc-refers-to"), sha1, n, x.inner, x.inner_length, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        for b in batches:
            for path in b.column("path").to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") if with_payload else 0
                    if len(held) >= 1024 or size >= 8 << 20:
                        yield give()
                        held, size = [], 0
        if held:
            yield give()

    return run


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of RECORD (kind record or gap) of the archives named by ``paths`` (path), a task for each file at most."""
    n = max(1, min(paths.count(), 100_000))
    return paths.select("path").repartition(n).mapInArrow(_read(with_payload), RECORD + ", payload binary" * with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives and read them back."""
    files = write_archives(dealt(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    page = lambda c: F.col(c).substr(F.lit(11), F.length(c) - 11).try_cast("long")
    back = read_archives(files).where("kind = 'record'")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to_id").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d),
g AS (
  SELECT page_id, h, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, 1 + 5 * k, 5) AS BIGINT) >> (15 - 5 * j)) & 31) AS BIGINT), 1), '' ORDER BY k, j) AS payload_digest
  FROM (SELECT DISTINCT page_id, h FROM d), (SELECT unnest(range(8)) AS k), (SELECT unnest(range(4)) AS j)
  GROUP BY page_id, h)
SELECT f.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN f.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.page_id = first THEN NULL ELSE first END AS refers_to
FROM f JOIN g ON f.page_id = g.page_id AND f.h = g.h
"""
