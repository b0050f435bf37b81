"""WARC archives: a writer, and a reader that recovers what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, write_and_reread

#: Compressed bytes after which the writer begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes read at once while looking for the next record.
WINDOW = 1 << 20
#: A record whose head or block is beyond these many bytes counts as damage.
MAX_RECORD = 1 << 30
#: Bytes read first, then twice as many each time up to WINDOW; inflated bytes of a member that are kept from its check to its records.
FIRST, KEPT = 64 << 10, 16 << 20
#: Payload bytes that a task hands on at once.
BATCH_BYTES = 8 << 20

VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
#: Digests that are checked; others are taken as they are.
ALGORITHMS = {x: getattr(hashlib, x) for x in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = ("path string, start bigint, end bigint, gap string, record_type string, record_id string, target_uri string, "
          "payload_digest string, payload_bytes bigint, refers_to string, payload binary")  # fmt: skip


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the head of the response and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=%~")))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def agrees(named: str, data: bytes) -> bool | None:
    """Whether a digest of a head, ``algorithm:value`` (without algorithm: SHA-1), is that of the data; None if it can't be told, for unknown algorithms.

    By its length the value is in hexadecimal, base 32 or base 64.
    """
    label, _, value = named.rpartition(":")
    made = ALGORITHMS.get((label or "sha1").strip().lower().replace("-", "").replace("_", ""))
    if made is None:
        return None
    want, value = made(data).digest(), value.strip().rstrip("=")
    if len(value) == 2 * len(want):
        return value.lower() == want.hex()
    if len(value) == -(-8 * len(want) // 5):
        return value.upper() == base64.b32encode(want).decode().rstrip("=")
    return value.replace("-", "+").replace("_", "/") == base64.b64encode(want).decode().rstrip("=")


class Damaged(Exception):
    """A check of a record failed."""


CUT = "member cut short"


class Stream:
    """Bytes of chunks that come one by one, by their places; those before ``base`` are given up. A fault in the chunks ends them."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.base = chunks, bytearray(), 0

    def more(self) -> bool:
        try:
            self.data += next(self.chunks)
        except (StopIteration, Damaged):
            return False
        return True

    def reach(self, end: int) -> bool:
        """Whether there are bytes up to ``end``."""
        while self.base + len(self.data) < end:
            if not self.more():
                return False
        return True

    def part(self, start: int, end: int) -> bytes:
        self.reach(end)
        return bytes(self.data[start - self.base : end - self.base])

    def find(self, what: bytes, start: int, limit: int | None = None) -> int:
        """The first place from ``start`` on that holds ``what``, or -1. Without a limit, bytes before ``start`` and those searched are given up."""
        while True:
            if limit is None:
                self.drop(start)
            at = self.data.find(what, start - self.base)
            if at >= 0:
                return self.base + at
            start = max(start, self.base + len(self.data) - len(what) + 1)
            if limit is not None and start > limit or not self.more():
                return -1

    def drop(self, end: int) -> None:
        done = min(end - self.base, len(self.data))
        if done > 0:
            del self.data[:done]
            self.base += done


def parse(stream: Stream, at: int) -> tuple[dict, int, bool]:
    """The record that starts at ``at``, where it ends, and whether a digest proves its block; raises `Damaged` unless all its checks hold."""
    if not VERSION_LINE.match(stream.part(at, at + 10)):
        raise Damaged("no version line")
    head, pos = {}, at + 10
    while True:
        line_end = stream.find(b"\r\n", pos, at + MAX_RECORD)
        if line_end < 0:
            raise Damaged("head without an end")
        line, pos = stream.part(pos, line_end), line_end + 2
        if not line:
            break
        if pos - at > MAX_RECORD:
            raise Damaged("record too long")
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("head line without a colon")
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = head.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    if len(length.lstrip("0")) > 18 or int(length) > MAX_RECORD:
        raise Damaged("record too long")
    end = pos + int(length)
    if stream.part(end, end + 4) != b"\r\n\r\n":
        raise Damaged("block cut short")
    block = stream.part(pos, end)
    named = head.get(b"warc-block-digest")
    proof = agrees(named, block) if named else None
    if proof is False:
        raise Damaged("block digest differs")
    kind = head.get(b"warc-type")
    http, gap, payload = block.partition(b"\r\n\r\n") if head.get(b"content-type", "").startswith("application/http") else (b"", b"", block)
    size = len(payload)
    named = head.get(b"warc-payload-digest") or None
    if kind == "revisit":
        said = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(said[0]) if said and said[0].isdigit() else None
        payload = None
    elif kind in ("response", "resource") and named and agrees(named, payload) is False:
        raise Damaged("payload digest differs")
    if named and re.fullmatch("(?i)(sha-?1:)?([0-9a-f]{40}|[a-z2-7]{32})", named):  # SHA-1 is told in base 32, without its label
        value = named.rpartition(":")[2].upper()
        named = base64.b32encode(bytes.fromhex(value)).decode() if len(value) == 40 else value
    uri, refers = head.get(b"warc-target-uri"), head.get(b"warc-refers-to")
    return {
        "record_type": kind, "record_id": head.get(b"warc-record-id", "").strip("<>"), "target_uri": unquote(uri) if uri is not None else None,
        "payload_digest": named, "payload_bytes": size, "refers_to": refers.strip("<>") if refers is not None else None, "payload": payload,
    }, end + 4, bool(proof)


def until_fault(unpack, chunk: bytes) -> Iterator[bytes]:
    """What a chunk with a fault gives before it."""
    try:
        for i in range(len(chunk)):
            if piece := unpack.decompress(chunk[i : i + 1]):
                yield piece
    except zlib.error:
        return


def inflated(file, at: int, size: int) -> Iterator[bytes]:
    """Bytes of the gzip member that starts at ``at``, piece by piece; its checksum is checked. Returns where the member ends, raises `Damaged` after the last sound piece."""
    unpack, pos, step = zlib.decompressobj(31), at, FIRST
    while not unpack.eof:
        if pos >= size:
            raise Damaged(CUT)
        file.seek(pos)
        chunk = file.read(min(step, size - pos))
        pos, step = pos + len(chunk), min(2 * step, WINDOW)
        while chunk and not unpack.eof:
            before = unpack.copy()
            try:
                piece = unpack.decompress(chunk, WINDOW)
            except zlib.error as e:
                yield from until_fault(before, chunk)
                raise Damaged(f"member: {e}") from None
            chunk = unpack.unconsumed_tail
            if piece:
                yield piece
    return pos - len(unpack.unused_data)


def as_is(file, at: int, size: int) -> Iterator[bytes]:
    """Bytes of the file from ``at`` on, piece by piece."""
    step = FIRST
    while at < size:
        file.seek(at)
        yield (chunk := file.read(min(step, size - at)))
        at, step = at + len(chunk), min(2 * step, WINDOW)


def records_of(stream: Stream, fault: str | None) -> Iterator[dict]:
    """Records and gaps of an inflated member. After a failed check it goes on at the next version line that holds a sound record.

    If the member has a fault, its gaps are left out, and unless it is just cut, so are records that no digest of their own proves.
    """
    pos = 0
    while stream.reach(pos + 1):
        try:
            found, end, proof = parse(stream, pos)
        except Damaged as e:
            place = stream.find(VERSION, pos + 1)
            while place >= 0:
                try:
                    parse(stream, place)
                    break
                except Damaged:
                    place = stream.find(VERSION, place + 1)
            if fault is None:
                yield {"gap": str(e)}
            if place < 0:
                return
            pos = place
            continue
        if proof or fault in (None, CUT):
            yield found | {"gap": None}
        pos = end
        stream.drop(pos)


def unit(file, at: int, size: int) -> tuple[Iterator[dict], int | None, str | None]:
    """The records of the member, or the plain record, that starts at ``at``, where it ends, and its fault, if it has one (then its end isn't known)."""
    file.seek(at)
    if file.read(3) != MEMBER:
        try:
            found, end, _ = parse(Stream(as_is(file, at, size)), 0)
        except Damaged as e:
            return iter(()), None, str(e)
        return iter((found | {"gap": None},)), at + end, None
    # the member's checksum comes last, so it is read to its end first; a long one is inflated again for its records
    pieces, total, end, fault, chunks = [], 0, None, None, inflated(file, at, size)
    while True:
        try:
            piece = next(chunks)
        except StopIteration as e:
            end = e.value
            break
        except Damaged as e:
            fault = str(e)
            break
        total += len(piece)
        if total <= KEPT:
            pieces.append(piece)
        else:
            pieces.clear()
    return records_of(Stream(iter(pieces) if total <= KEPT else inflated(file, at, size)), fault), end, fault


def candidates(file, start: int, size: int) -> Iterator[int]:
    """Places from ``start`` on where a member or a version line may begin, in order."""
    keep = max(len(VERSION), len(MEMBER)) - 1
    pos = start
    while pos < size:
        file.seek(pos)
        data = file.read(min(WINDOW + keep, size - pos))
        at = -1
        while True:
            hits = [x for x in (data.find(MEMBER, at + 1), data.find(VERSION, at + 1)) if x >= 0]
            if not hits or min(hits) >= WINDOW:
                break
            at = min(hits)
            yield pos + at
        pos += WINDOW


def salvage(file, size: int) -> Iterator[dict]:
    """Records of an archive in order, with ``start`` and ``end`` of the member or plain record they lie in.

    Where a check fails, the bytes up to the next place that holds a sound record are passed over and told as a row with ``gap``, the
    reason, and neither type nor payload. In a sound member only the record at fault is passed over. The gap of a member that is itself at fault covers it whole, and its sound records
    come before the gap's row. Recovery never joins bytes from both sides of a gap.
    """
    pos = 0
    while pos < size:
        rows, end, fault = unit(file, pos, size)
        if fault is not None:
            end = next((p for p in candidates(file, pos + 1, size) if any(r["gap"] is None for r in unit(file, p, size)[0])), size)
        for r in rows:
            yield r | {"start": pos, "end": end}
        if fault is not None:
            yield {"start": pos, "end": end, "gap": fault}
        pos = end


def write(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row into gzipped archives below ``folder`` and returns ``path, records, bytes`` of each archive.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest
    id is the response (rows that repeat its id, too); the others are revisits of it. Rows without an id are revisits if a row with an
    id has their payload, else responses. A null address is left out of the head. Other columns are ignored; an empty table
    gives no archives.

    ``folder`` must be one that all executors share, as a path or a URI that Arrow can open. An archive's name holds the attempt that wrote
    it and only archives of attempts that succeeded are returned, so lost executors and repeated tasks leave at most stray files.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[uri_col].cast("string").alias("uri"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.when(F.octet_length("text") >= min_bytes, F.sha1(F.col("text").cast("binary"))))
    first = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "key", "left").select(F.col("id").cast("string").alias("id"), "uri", "text", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        task = TaskContext.get()
        name = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        urn = lambda x: f"urn:x-page:{x or ''}"
        out, path, made = None, "", []
        for b in batches:
            for page, uri, text, refers in zip(b["id"], b["uri"], b["text"], b["refers_to"], strict=True):
                if out is None:
                    path = f"{name}-{len(made):05d}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                data = record("revisit" if refers else "response", urn(page), uri, text.encode(), urn(refers) if refers else None, date)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, records, size))
        scheme = folder.partition("://")[0] if "://" in folder else ""
        prefix = folder.rstrip("/").removesuffix(top.rstrip("/")) if scheme else ""
        yield pd.DataFrame([(prefix + p, n, s) for p, n, s in made], columns=["path", "records", "bytes"])

    archives = rows.mapInPandas(run, "path string, records bigint, bytes bigint")
    return write_and_reread(archives, "archives")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in the ``path`` column, gzipped or plain: see `salvage` and `FIELDS`.

    A file that can't be opened raises; an empty one has no rows. ``archives`` may be empty. Null paths are skipped. Each archive is read by one task, in
    windows; records come one at a time, so a task needs memory for the largest record, however long its member is.
    """
    spark = archives.sparkSession
    names = FIELDS.replace(" string", "").replace(" bigint", "").replace(" binary", "").split(", ")
    paths = archives.where("path is not null").select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for path in (p for b in batches for p in b["path"]):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as file:
                for r in salvage(file, file.size()):
                    size += len(r.get("payload") or b"") if with_payload else 0
                    found.append([path if c == "path" else None if c == "payload" and not with_payload else r.get(c) for c in names])
                    if size >= BATCH_BYTES or len(found) >= 5000:
                        yield pd.DataFrame(found, columns=names, dtype=object)
                        found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=names, dtype=object)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.repartition(tasks, "path").mapInPandas(run, FIELDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into archives in the scratch folder and returns what the reader finds in them, without payloads; raises if bytes were quarantined."""
    rows = read(write(pages, scratch_path(spark, "warc")), with_payload=False)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("bigint")
    return rows.where(F.when(F.col("gap").isNotNull(), F.raise_error(F.concat(F.lit("damaged archive: "), "path", F.lit(": "), "gap")).cast("boolean")).otherwise(True)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
