"""Operator 8: WARC archives, written one gzip member a record, and a splittable reader.

Writing: a page's payload is a response record; a page whose payload (of at least
``least`` bytes) equals that of a smaller page id becomes a revisit record that
names it.  Tasks write files of their own under the given folder through Arrow's
file systems; only files that the committed manifest lists count, so a lost or
repeated task leaves nothing that is read.

Reading: tasks get byte ranges.  They look for the gzip magic from the range's
start, try to decode a member's beginning and accept it if it is a whole WARC
header; from there on members follow each other.  A record belongs to the range in
which its member starts, and is read past the range's end if need be.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.llm.staging import shared_folder, staged

# ---- fixed values of the formats ------------------------------------------------------
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 64 << 20     # an archive file is closed beyond this size
SPLIT_BYTES = 8 << 20     # bytes of a reader's range
CHUNK = 1 << 20           # bytes read at once
HEAD = 1 << 16            # compressed bytes decoded at once in search of a header's end


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of an absolute path or URI, and the path in it."""
    if uri.startswith("file:/"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _line(text: str) -> str:
    """A header value on one line: control characters and spaces as percent escapes."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, when: str,
           extra: list[tuple[str, str]]) -> bytes:
    """A whole record, uncompressed.  A revisit has the HTTP header alone."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", when)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), *extra,
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    """A record's id, by its page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (names in lower case) and the header's length, if ``data`` begins with a whole one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


class _Window:
    """Bytes of a file from a moving position on."""

    def __init__(self, source, at: int):
        self.source, self.start, self.data = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        got = self.source.read(CHUNK)
        self.data += got
        return bool(got)

    def drop(self, count: int) -> None:
        self.data = self.data[count:]
        self.start += count


def _begins_record(window: _Window, at: int) -> bool:
    """The bytes from ``at`` decode to a gzip member that begins with a WARC header."""
    member = zlib.decompressobj(31)
    head = bytearray()
    try:
        while not member.eof:
            if at == len(window.data) and not window.more():
                return False
            part = window.data[at:at + HEAD]
            at += len(part)
            while part and not member.eof:
                seen = len(head)
                head += member.decompress(part, CHUNK)
                part = member.unconsumed_tail
                if not head.startswith(b"WARC/"[:len(head)]):
                    return False
                end = head.find(b"\r\n\r\n", max(0, seen - 3))
                if end >= 0:
                    return _header(bytes(head[:end + 4])) is not None
    except zlib.error:
        pass
    return False


def records_in(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose member starts in [start, end): (offset, header fields, block)."""
    window = _Window(source, start)
    aligned = False
    while window.start < end:
        if not aligned:
            at = window.data.find(MAGIC)
            if at < 0:
                window.drop(max(0, len(window.data) - 2))
                if not window.more():
                    return
                continue
            window.drop(at)
            if window.start >= end:
                return
            if not _begins_record(window, 0):
                window.drop(1)
                continue
        elif not window.data and not window.more():
            return
        member = zlib.decompressobj(31)
        parts = []
        offset = window.start
        try:
            while not member.eof:
                if not window.data and not window.more():
                    return                       # cut off in its middle
                parts.append(member.decompress(window.data))
                used = len(window.data) - len(member.unused_data)
                window.drop(used)
        except zlib.error:
            aligned = False
            if window.start == offset:
                window.drop(1)
            continue
        text = b"".join(parts)
        parsed = _header(text)
        aligned = True
        if parsed is None:
            continue
        fields, head = parsed
        yield offset, fields, text[head:head + int(fields["content-length"])]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
          least: int = 100, when: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into gzip archives under ``folder``; returns the manifest (file, bytes, records).

    A null payload is empty.  Of rows with equal payloads of at least ``least``
    bytes the one with the smallest id is the response (null ids come last; rows
    that repeat that id are responses too), the others are revisits of it.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = base.where(F.col("size") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A null id that is the first of its payload repeats itself: all such rows are responses.
    rows = base.join(first.select("digest", "first"), "digest", "left").select(
        "id", "url", "payload", "digest", F.col("first.id").alias("first_id"),
        F.coalesce(~F.col("id").eqNullSafe(F.col("first.id")) & F.col("first").isNotNull(), F.lit(False)).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, count, size, files = None, 0, 0, 0
        name = ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                    out, count, size, files = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0, files + 1
                extra = [] if row["id"] is None else [("X-Page-Id", str(row["id"]))]
                kind = "response"
                if row["again"]:
                    kind = "revisit"
                    extra += [("WARC-Refers-To", record_id(row["first_id"], row["digest"])), ("WARC-Profile", REVISIT_PROFILE)]
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(kind, record_id(row["id"], row["digest"]), row["url"],
                                                row["payload"].encode(), row["digest"], when, extra)) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return staged(rows.mapInArrow(run, "file string, bytes long, records long"), "manifest")


READ_TASKS = 100_000  # tasks of one read at most; beyond that a task reads several ranges


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Read archives (rows ``file``, ``bytes``) by byte ranges.

    Returns (file, offset, record_type, record_id, page_id, target_uri,
    refers_to_id, digest, payload): payload is the HTTP body, null for revisits.
    """
    ranges = files.select("file", "bytes", F.explode(
        F.when(F.col("bytes") > 0, F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ).alias("start"))
    ranges = ranges.select("file", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    # As many tasks as ranges: a number that is given is not coalesced, however small the rows that name the ranges.
    count = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    ranges = ranges.repartition(max(1, min(int(count), READ_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["file"])
                found, held = [], 0
                with system.open_input_file(path) as source:
                    for offset, fields, block in records_in(source, row["start"], row["end"]):
                        kind = fields["warc-type"]
                        body = None
                        if kind == "response":
                            body = block[block.find(b"\r\n\r\n") + 4:]
                        page = fields.get("x-page-id")
                        found.append((row["file"], offset, kind, fields.get("warc-record-id"),
                                      None if page is None else int(page), fields.get("warc-target-uri"),
                                      fields.get("warc-refers-to"),
                                      fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, body))
                        held += len(block)
                        if held > CHUNK * 8:
                            yield _rows(found)
                            found, held = [], 0
                if found:
                    yield _rows(found)

    return ranges.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _COLUMNS))


_COLUMNS = [("file", "string"), ("offset", "long"), ("record_type", "string"), ("record_id", "string"),
            ("page_id", "long"), ("target_uri", "string"), ("refers_to_id", "string"), ("digest", "string"),
            ("payload", "binary")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*found), _COLUMNS)],
                                      names=[c for c, _ in _COLUMNS])


def resolve(records: DataFrame) -> DataFrame:
    """Per page: size and digest of the full payload, kind of record, and the page a revisit refers to.

    A revisit's size comes from the response it names; its digest from its own header.
    """
    known = staged(records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "record_type", "page_id", "refers_to_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
        .alias("payload_digest")), "records")
    of = known.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("of_bytes"))
    revisits = known.where("record_type = 'revisit'").join(of, "refers_to_id", "left").select(
        "page_id", F.col("of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    responses = known.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, one row per page.

    Repeated rows, ties and null ids as in ``write``; other columns play no part;
    an empty table gives an empty table.
    """
    manifest = write(pages, shared_folder(pages.sparkSession, "warc"), **options)
    return resolve(read(manifest))
