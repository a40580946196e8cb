"""WARC archives: deduplicated writer and salvage reader.

Writer. Each page is one gzip member with one record. Of records with equal
payloads of at least ``revisit_bytes`` bytes the one with the least page id is
a response, the others are revisits that name it and carry no payload. Archives
are cut at ``archive_bytes`` and written under a temporary name, then renamed;
names follow from the partition, so a repeated task replaces its own files.

Salvage reader. A member or record that fails a check (gzip CRC and length,
version line, headers, Content-Length, end mark, payload digest) is given up;
the reader looks for the next gzip magic or version line from which a whole
valid record can be read, goes on there, and logs the bytes between as a gap.
Inside a member it does the same with the inflated bytes: records before and
after a damage that pass their own digest are kept, those without a digest only
if the member's checks hold. The writer adds a digest of the headers, which the
block digest leaves out; other writers' headers are unprotected there.
Plain and compressed records may follow one another in one file.

At scale. Digests are grouped with map-side partials and only repeated ones are
joined back (shuffled and split where hot, unless few). Archives are read in
windows of 1 MB and inflated as they are read; memory is bounded by one record
(and by what a member holds without digests). Archives live in the folder
that all executors share, through Arrow's file systems.

Edge cases. A null html is an empty payload, a null URL an empty target; line
ends in URLs are percent-encoded. Pages with a null id are responses unless a
page with an id has their payload. Repeated rows with the least id are all
responses. Extra columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.runtime import cut, shared_folder, small

VERSION = b"WARC/1.1\r\n"
_MAGIC, _LINE, _WINDOW = b"\x1f\x8b\x08", b"WARC/1.", 1 << 20
_END = b"\r\n\r\n"
#: An extension header, the last one: the SHA-256 of the header lines before it.
_OWN = "X-Header-Digest"


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record. A revisit (refers_to given) keeps the payload's length in its HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + f"{_OWN}: {hashlib.sha256(lines).hexdigest()}\r\n\r\n".encode() + block + _END


def member(data: bytes) -> bytes:
    """data as one gzip member without time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Source:
    """A file read in windows from any offset."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, _WINDOW))
        return self.held[start - self.at : start - self.at + n]

    def find(self, start: int) -> int:
        """The next gzip magic or version line at or after start; size if none."""
        while start < self.size:
            window = self.read(start, _WINDOW)
            hits = [h for h in (window.find(_MAGIC), window.find(_LINE)) if h >= 0]
            if hits:
                return start + min(hits)
            if start + len(window) >= self.size:
                break
            start += max(1, len(window) - len(_LINE) + 1)
        return self.size


class _Inflated:
    """What a gzip member holds, inflated as far as it is read. At a damage it
    ends with the bytes that came before."""

    def __init__(self, source: _Source, start: int):
        self.source, self.at = source, start
        self.z, self.base, self.held, self.done, self.reason = zlib.decompressobj(31), 0, bytearray(), False, None

    @property
    def end(self) -> int:
        return self.base + len(self.held)

    def _more(self) -> None:
        piece, saved = self.source.read(self.at, 65536), self.z.copy()
        if not piece:
            self.done, self.reason = True, "cut member"
            return
        try:
            self.held += self.z.decompress(piece)
            self.at += len(piece)
        except zlib.error:
            self.done, self.reason = True, "bad member"
            for k in range(len(piece)):
                try:
                    self.held += saved.decompress(piece[k : k + 1])
                except zlib.error:
                    return
        if self.z.eof:
            self.at -= len(self.z.unused_data)
            self.done = True

    def read(self, start: int, n: int) -> bytes:
        while not self.done and self.end < start + n:
            self._more()
        return bytes(self.held[start - self.base : start - self.base + n])

    def find(self, start: int) -> int:
        """The next version line at or after start; the end if none. Bytes before are let go."""
        while True:
            hit = self.held.find(_LINE, start - self.base)
            if hit >= 0 or self.done:
                start = self.base + hit if hit >= 0 else self.end
                self.drop(start)
                return start
            start = max(start, self.end - len(_LINE) + 1)
            self.drop(start)
            self._more()

    def drop(self, start: int) -> None:
        del self.held[: start - self.base]
        self.base = start


class Broken(ValueError):
    """A record that fails a check."""


def _plain(get, start: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at start; get(start, n) reads bytes."""
    head, size = b"", 0
    while _END not in head:
        # all lines but the first must be headers: what is none ends the search
        if any(b": " not in line for line in head.split(b"\r\n")[1:-1]):
            raise Broken("bad headers")
        size = 2 * size or 4096
        more = get(start, size)
        if len(more) == len(head):
            raise Broken("no end of headers")
        head = more
    lines, _, _ = head.partition(_END)
    first, *rest = lines.split(b"\r\n")
    if not (first.startswith(_LINE) and first[len(_LINE) :].isdigit()):
        raise Broken("no version line")
    try:
        headers = dict(line.decode().split(": ", 1) for line in rest)
        n = int(headers["Content-Length"])
    except (ValueError, KeyError, UnicodeDecodeError) as e:
        raise Broken("bad headers") from e
    at = start + len(lines) + len(_END)
    block = get(at, n) if n > 0 else b""
    if n < 0 or len(block) < n or get(at + n, 4) != _END:
        raise Broken("bad length")
    if _OWN in headers and hashlib.sha256(b"".join(line + b"\r\n" for line in rest[:-1])).hexdigest() != headers[_OWN]:
        raise Broken("bad header digest")
    want = headers.get("WARC-Block-Digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise Broken("bad block digest")
    return headers, block, at + n + 4


def _inside(inner: _Inflated) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """Records and gaps of a member, at inflated offsets. Records that carry no
    digest come last, and only if the member's own checks hold."""
    at, gap, reason, unsure = 0, None, "", []
    while inner.read(at, 1):
        try:
            headers, block, end = _plain(inner.read, at)
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = inner.find(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, {"reason": reason}, b""
            gap = None
        if headers.get("WARC-Block-Digest", "").startswith("sha256:"):
            yield "record", at, end, headers, block
        else:
            unsure.append(("record", at, end, headers, block))
        at = end
        inner.drop(at)
    if gap is not None:
        yield "gap", gap, at, {"reason": reason}, b""
    yield from unsure if inner.reason is None else (("gap", begin, end, {"reason": inner.reason}, b"") for _, begin, end, _, _ in unsure)


def salvage(file, size: int) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', offset, end, headers, block) and ('gap', offset, end, {'reason': ...}, b'').

    Records of a member have the member's offsets. A gap inside a member that
    gave records too has the member's offset twice and tells the inflated bytes.
    """
    source, at, gap, reason = _Source(file, size), 0, None, ""
    while at < size:
        if source.read(at, 3) == _MAGIC:
            inner, found, holes = _Inflated(source, at), False, []
            for what, begin, end, headers, block in _inside(inner):
                if what == "gap":
                    holes.append(f"{headers['reason']}, inflated bytes {begin} to {end}")
                    continue
                found = True
                if gap is not None:
                    yield "gap", gap, at, {"reason": reason}, b""
                    gap = None
                yield "record", at, inner.at, headers, block
            if found:
                for hole in holes:
                    yield "gap", at, at, {"reason": hole}, b""
            if inner.reason is None and (found or not inner.end):
                at = inner.at
                continue
            why, after = inner.reason or "no record in member", inner.at if inner.reason is None else at + 1
        elif source.read(at, len(_LINE)) == _LINE:
            try:
                headers, block, end = _plain(source.read, at)
                if gap is not None:
                    yield "gap", gap, at, {"reason": reason}, b""
                    gap = None
                yield "record", at, end, headers, block
                at = end
                continue
            except Broken as e:
                why, after = str(e), at + 1
        else:
            why, after = "no record here", at + 1
        if gap is None:
            gap, reason = at, why
        at = source.find(after)
    if gap is not None:
        yield "gap", gap, size, {"reason": reason}, b""


def _write_batches(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt, number = context.partitionId(), context.taskAttemptId(), 0
        out, path, written, records = None, "", 0, 0

        def close():
            out.close()
            system.move(f"{path}.{attempt}", path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([written]), pa.array([records])], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c for c in batch.columns)):
                data = member(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
                if out is None:
                    path = f"{root}/part-{part:06d}-{number:04d}.warc.gz"
                    out, written, records, number = system.open_output_stream(f"{path}.{attempt}", compression=None), 0, 0, number + 1
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 100, archive_bytes: int = 32 << 20, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages' archives; returns (path, bytes, records) of each."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, root = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    equal = cut(equal.select("digest", "least"))
    refers = F.when(F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("page_id")), F.col("least"))
    dealt = rows.join(small(equal, 96), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return cut(dealt.mapInArrow(_write_batches(folder, archive_bytes), "path string, bytes long, records long"))


def _read_batches(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                with system.open_input_file(path) as file:
                    for what, begin, end, headers, block in salvage(file, file.size()):
                        row = {"path": path, "begin": begin, "end": end}
                        if what == "gap":
                            row |= {"gap": headers["reason"]}
                        else:
                            row |= _fields(headers, block)
                        held.append(row)
                        size += len(block)
                        if size >= 4 << 20 or len(held) >= 2000:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return run


_SCHEMA = pa.schema(
    [("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _rows(held: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(held, schema=_SCHEMA)


_URN = "<urn:page:"


def _urn(page_id) -> str:
    return "<urn:no-page>" if page_id is None else f"{_URN}{quote(str(page_id), safe='')}>"


def _name(value: str | None) -> str | None:
    return unquote(value[len(_URN) : -1]) if value and value.startswith(_URN) else None


def _fields(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(_END)
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind, digest = headers.get("WARC-Type"), headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    out = {"page": _name(headers.get("WARC-Record-ID")), "url": headers.get("WARC-Target-URI"), "record_type": kind, "refers": _name(headers.get("WARC-Refers-To"))}
    out |= {"payload_digest": digest, "payload_bytes": length, "payload": payload}
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        out["gap"] = "bad payload digest"
    return out


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Records and gaps of archives(path) on the file system of uri: path, begin,
    end, gap (reason; null for records), page, url, record_type, refers,
    payload_digest, payload_bytes, payload."""
    schema = "path string, begin long, end long, gap string, page string, url string, record_type string, refers string, payload_digest string, payload_bytes long, payload binary"
    return archives.select("path").mapInArrow(_read_batches(uri), schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    page, as read back from its archives."""
    kind = pages.schema[options.get("ident", "page_id")].dataType
    archives = write_archives(pages, **options)
    read = read_archives(archives, shared_folder(pages.sparkSession))
    # what was just written must come back whole
    read = read.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "begin", "gap")).cast("boolean")))
    return read.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
