"""Converting legacy ARC archives to WARC.

An ARC file starts with a version block whose record line names a
``filedesc://`` address; its body gives the version and the field list of the
record lines that follow.  Version 1 lines have five fields, version 2 lines
ten.  A record is its line, exactly as many bytes as the line's last field
declares, and a line break.

WARC records are made from them: the identifier is a UUID derived from the
archive's name and the record's offset in it, so that converting anew gives
the same one; the date is the line's 14-digit time in ISO form; the type is
``response``, or ``revisit`` where the payload was seen before; digests are
SHA-256 of the payload and of the block.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.llm.storage import new_dir, written

#: The record line fields of both versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6f1a2f5e-3d57-5b0e-9a51-6c7d7f0c2b11")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100


# ---- ARC ------------------------------------------------------------------


def arc_head(version: int, name: str, when: str) -> bytes:
    """The version block of an archive."""
    body = f"{version} 0 Legacy-Crawl\n{FIELDS[version]}\n".encode()
    rest = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {when} text/plain{rest} {len(body)}\n".encode() + body + b"\n"


#: The head before the html of every page that is written.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def arc_record(version: int, url: str, when: str, kind: str, name: str, at: int, block: bytes) -> bytes:
    """One record, whose line takes the form of the version."""
    rest = "" if version == 1 else f" 200 - - {at} {name}"
    return f"{url} 0.0.0.0 {when} {kind}{rest} {len(block)}\n".encode() + block + b"\n"


class ArcError(ValueError):
    pass


#: A record line's address, IP address and date, told by their forms: an address and
#: a content type may hold blanks.
_LINE = re.compile(r"(.*) (\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+) (\d{4,14}) (.*)", re.DOTALL)
_FIRST = FIELDS[1].split()[:4]


def arc_fields(line: str, names: list[str]) -> dict[str, str]:
    """The fields of a record line; :class:`ArcError` if it isn't one.

    Where the fields begin as both versions have them, the IP address and the
    date are found by their forms, the last such pair; all behind the content
    type are counted from the right.  Other lists of fields, which say nothing
    of forms, are counted from the right as a whole.
    """
    if names[:4] == _FIRST:
        found = _LINE.fullmatch(line)
        parts = [*found.groups()[:3], *found[4].rsplit(" ", len(names) - 4)] if found else []
    else:
        parts = line.rsplit(" ", len(names) - 1)
    if len(parts) != len(names):
        raise ArcError("a line without the fields stated")
    if not (parts[-1].isascii() and parts[-1].isdigit()):
        raise ArcError("no length")
    return dict(zip(names, parts, strict=True))


def read_arc(stream, bad: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, line, block) of each record after the version block.

    The field list that the version block states decides how lines are read, see
    :func:`arc_fields`.  Without ``bad`` whatever can't be read raises
    :class:`ArcError`.  With it (offset, bytes, reason) of that is put there and
    reading goes on at the next line that is a record's: a line in error costs
    itself and its block; one that declares more bytes than follow, and an
    archive without a version block, all to the end.
    """
    at = 0
    names: list[str] | None = None
    lost: list | None = None  # where, and why, reading went wrong

    def wrong(offset: int, size: int, reason: str) -> None:
        if bad is None:
            raise ArcError(f"{reason} at {offset}")
        bad.append((offset, size, reason))

    while line := stream.readline():
        begin, at = at, at + len(line)
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not text.strip():
            continue
        if names is None:
            parts = text.split()
            length = parts[-1] if parts[0].startswith("filedesc://") else ""
            body = stream.read(int(length)) if length.isascii() and length.isdigit() else b""
            at += len(body)
            first, _, rest = body.partition(b"\n")
            version = first.split()[:1]
            if version not in ([b"1"], [b"2"]) or not rest.strip():
                while more := stream.read(1 << 20):
                    at += len(more)
                wrong(begin, at - begin, "no version block")
                return
            names = rest.split(b"\n")[0].decode("utf-8", "surrogateescape").split()
            continue
        try:
            fields = arc_fields(text, names)
        except ArcError as error:
            if bad is None:
                raise ArcError(f"{error} at {begin}") from None
            lost = lost or [begin, str(error)]
            continue
        if lost:
            wrong(lost[0], begin - lost[0], lost[1])
            lost = None
        length = int(fields[names[-1]])
        block = stream.read(length)
        at += len(block)
        if len(block) != length:
            wrong(begin, at - begin, f"{len(block)} of {length} bytes")
            return
        yield begin, fields, block
    if lost:
        wrong(lost[0], at - lost[0], lost[1])


def payload_of(line: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, where it has one."""
    if block.startswith(b"HTTP/"):
        head, mark, body = block.partition(b"\r\n\r\n")
        if mark:
            return body
    return block


# ---- WARC -----------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}>"


def iso_time(digits: str) -> str:
    """ARC's YYYYMMDDhhmmss in WARC's form; shorter ones are filled up."""
    digits = digits if digits.isdigit() else ""
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        yield headers, block


# ---- Spark ----------------------------------------------------------------

_STAMP = pa.schema([("folder", pa.string()), ("path", pa.string()), ("records", pa.int64())])


def _new_file(folder: str, kind: str):
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{kind}.gz"
    return name, fs.open_output_stream(f"{root}/{name}", compression=None)


def _member(record: bytes) -> bytes:
    """A record as a gzip member of its own, as archives keep them."""
    return gzip.compress(record, compresslevel=1, mtime=0)


class _Lines:
    """readline and exact read over the members of a compressed archive."""

    def __init__(self, folder: str, path: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        self._stream, self._held = fs.open_input_stream(f"{root}/{path}", compression=None), b""
        self._inflate, self._rest = zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        while True:
            if self._inflate.eof:
                self._rest, self._inflate = self._inflate.unused_data, zlib.decompressobj(31)
            raw = self._rest or self._stream.read(1 << 16)
            self._rest = b""
            if not raw:
                return b""
            if out := self._inflate.decompress(raw):
                return out

    def readline(self) -> bytes:
        while (end := self._held.find(b"\n")) < 0:
            more = self._more()
            if not more:
                line, self._held = self._held, b""
                return line
            self._held += more
        line, self._held = self._held[: end + 1], self._held[end + 1 :]
        return line

    def read(self, n: int) -> bytes:
        parts, size = [self._held], len(self._held)
        while size < n and (more := self._more()):
            parts.append(more)
            size += len(more)
        whole = b"".join(parts)
        self._held = whole[n:]
        return whole[:n]


def write_arcs(pages: DataFrame, version: Column | int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC files in shared storage, at
    most one of each version for each partition that is read.  Every block has
    an HTTP head of its own, so a page that begins like one stays whole.

    Null html is an empty payload, null url ``about:blank``; blanks in an
    address are escaped, as a record line is cut at blanks.  The page_id stands
    in the address's fragment (``#page=7``), which the archives keep and servers
    never see.  Returns (folder, path, records), a row per file.
    """
    folder = new_dir(pages.sparkSession, "arc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), (F.lit(version) if isinstance(version, int) else version).cast("int").alias("version"))

    def write(batches) -> Iterator[pa.RecordBatch]:
        files: dict[int, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    kind = r["version"]
                    when = f"{2000 + kind:04d}0101000000"
                    if kind not in files:
                        name, out = _new_file(folder, "arc")
                        head = arc_head(kind, name, when)
                        out.write(_member(head))
                        files[kind] = [name, out, len(head), 0]
                    own = files[kind]
                    mark = "" if r["page_id"] is None else r["page_id"]
                    url = "%20".join((r["url"] or "about:blank").split()) or "about:blank"
                    record = arc_record(kind, f"{url}#page={mark}", when, "text/html", own[0], own[2], HTTP_HEAD + (r["html"] or "").encode())
                    own[1].write(_member(record))
                    own[2] += len(record)
                    own[3] += 1
        for own in files.values():
            own[1].close()
        if files:
            yield pa.RecordBatch.from_pylist([{"folder": folder, "path": f[0], "records": f[3]} for f in files.values()], schema=_STAMP)

    return written(rows.mapInArrow(write, "folder string, path string, records long"), "arcs")


def _each_file(files: DataFrame, n: int | None = None) -> DataFrame:
    """One task per archive; n: how many there are."""
    return files.repartition(max(1, files.count() if n is None else n), "path")


def arc_index(files: DataFrame, strict: bool = False) -> DataFrame:
    """(folder, path, offset, url, payload_bytes, payload_digest) of every
    record of ARC files (folder, path) that can be read; :func:`arc_errors` has
    what can't.  ``strict``: that raises instead."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("folder", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for f in batch.to_pylist():
                rows = []
                for offset, line, block in read_arc(_Lines(f["folder"], f["path"]), None if strict else []):
                    body = payload_of(line, block)
                    rows.append({"folder": f["folder"], "path": f["path"], "offset": offset, "url": line["URL"], "payload_bytes": len(body), "payload_digest": sha256(body).hexdigest()})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _each_file(files).mapInArrow(scan, "folder string, path string, offset long, url string, payload_bytes long, payload_digest string")


def arc_errors(files: DataFrame) -> DataFrame:
    """(folder, path, offset, bytes, reason) of whatever in ARC files is no record."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("folder", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for f in batch.to_pylist():
                bad: list[tuple[int, int, str]] = []
                for _ in read_arc(_Lines(f["folder"], f["path"]), bad):
                    pass
                yield pa.RecordBatch.from_pylist([f | {"offset": o, "bytes": n, "reason": why} for o, n, why in bad], schema=schema)

    return _each_file(files.select("folder", "path")).mapInArrow(scan, "folder string, path string, offset long, bytes long, reason string")


def page_of(url: Column) -> Column:
    """The page_id that :func:`write_arcs` put into an address."""
    return F.regexp_extract(url, "#page=(-?[0-9]+)$", 1).try_cast("long")


def first_of_equal(index: DataFrame) -> DataFrame:
    """Add ``page_id`` and ``refers_to`` (folder/path/offset/page of the record
    to revisit, null for responses) to an index.

    Of the records with equal payloads of ``REVISIT_BYTES`` or more, the one of
    the smallest page_id is the response (ties: by file and offset).  Digests
    are counted before they are joined, so only those met twice are looked up.
    """
    own = index.withColumn("page_id", page_of(F.col("url")))
    key = F.struct("page_id", "path", "offset")
    again = own.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = again.select(F.col("payload_digest").alias("_digest"), "_first")
    large = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("payload_digest"))
    joined = own.withColumn("_own", large).join(again, F.col("_own") == F.col("_digest"), "left")
    later = F.col("_first").isNotNull() & ((F.col("_first.path") != F.col("path")) | (F.col("_first.offset") != F.col("offset")))
    return joined.withColumn("refers_to", F.when(later, F.col("_first"))).drop("_own", "_digest", "_first")


def convert(files: DataFrame, strict: bool = False) -> DataFrame:
    """Convert ARC files (folder, path) to WARC files in shared storage.

    Returns (folder, path, records) of the WARC files, one per ARC file: a
    warcinfo record, then a record per ARC record in the same order.  A revisit
    names the record it refers to by its id and keeps no payload.  What is no
    record (:func:`arc_errors`) is passed over, or raises if ``strict``.  Archives are read twice: for
    their digests, which are written, and to be converted.
    """
    folder = new_dir(files.sparkSession, "warc")
    plan = first_of_equal(written(arc_index(files, strict), "arc-index")).where("refers_to IS NOT NULL")
    plan = plan.groupBy("folder", "path").agg(F.collect_list(F.struct("offset", "refers_to")).alias("revisits"))  # of one archive, whose size is bounded
    work = files.select("folder", "path").join(plan, ["folder", "path"], "left")

    def write(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                revisits = {r["offset"]: r["refers_to"] for r in f["revisits"] or []}
                name, out = _new_file(folder, "warc")
                with out:
                    info = f"software: prudentia\r\nformat: WARC File Format 1.1\r\nconverted-from: {f['path']}\r\n".encode()
                    out.write(_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f["path"], -1)), ("WARC-Date", iso_time("")), ("Content-Type", "application/warc-fields")], info)))
                    n = 0
                    for offset, line, block in read_arc(_Lines(f["folder"], f["path"]), None if strict else []):
                        body = payload_of(line, block)
                        head = block[: len(block) - len(body)]
                        digest = sha256(body).hexdigest()
                        to = revisits.get(offset)
                        headers = [("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", record_id(f["path"], offset)), ("WARC-Date", iso_time(line["Archive-date"])), ("WARC-Target-URI", line["URL"]), ("WARC-IP-Address", line["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(body)))]
                        if to:
                            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to["path"], to["offset"]))]
                            if to["page_id"] is not None:
                                headers.append(("X-Refers-To-Page", str(to["page_id"])))
                            block = head
                        headers += [("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response" if head else line["Content-type"])]
                        out.write(_member(warc_record(headers, block)))
                        n += 1
                yield pa.RecordBatch.from_pylist([{"folder": folder, "path": name, "records": n}], schema=_STAMP)

    return written(_each_file(work, files.count()).mapInArrow(write, "folder string, path string, records long"), "warcs")


def warc_index(files: DataFrame) -> DataFrame:
    """What WARC files (folder, path) hold, from their own bytes: (url,
    record_id, record_type, payload_bytes, payload_digest, refers_to_page,
    refers_to_id).  The digest of a response is taken from its payload and must
    equal the stated one."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_page", pa.int64()), ("refers_to_id", pa.string())])
        for batch in batches:
            for f in batch.to_pylist():
                rows = []
                for h, block in read_warc(_Lines(f["folder"], f["path"])):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    stated = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        body = payload_of({}, block) if h["Content-Type"].startswith("application/http") else block
                        if sha256(body).hexdigest() != stated or len(body) != size:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                    page = h.get("X-Refers-To-Page")
                    rows.append({"url": h["WARC-Target-URI"], "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"], "payload_bytes": size, "payload_digest": stated, "refers_to_page": None if page is None else int(page), "refers_to_id": h.get("WARC-Refers-To")})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _each_file(files).mapInArrow(scan, "url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_page long, refers_to_id string")
