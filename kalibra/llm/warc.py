"""ARC archives as WARC archives, with copies as revisits (operator 13).

Archives are written by Spark's text writer, whose line separator is what the formats put between records: any store and
Spark's commit protocol will do. Files are compressed as a whole; both are read with or without compression.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: The fields of a record's header line, by version of the ARC format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Header lines by version. URLs and content types of old archives may hold spaces; the date between them tells where they end.
HEADERS = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{12}(?:\d\d)?) (?P<type>.*?) ?(?P<length>\d+)\r?\n"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{12}(?:\d\d)?) (?P<type>.*?) ?(?P<status>\d{3}|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)\r?\n"),
}
HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Fixed value: the profile of revisits that are told by their payload's digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of so large a share of the records (one in so many) are looked up by a broadcast, so at most so many are.
HOT_SHARE = 1000
PORTION = 4 << 20
RECORD = pa.schema([("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("truncated", pa.bool_()), ("head", pa.binary()), ("payload", pa.binary())])
RECORD_DDL = "kind string, file string, offset long, key long, url string, date string, ip string, type string, digest string, payload_bytes long, truncated boolean, head binary, payload binary"
READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
READ_DDL = "record_id string, record_type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, block binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the formats' digest


class Stream:
    """Lines and blocks of an archive's content, which is inflated bit by bit where it is compressed (also record by record). What
    can't be inflated ends the archive."""

    def __init__(self, content: bytes):
        self.parts = self._inflated(content) if content[:2] == b"\x1f\x8b" else iter([content])
        self.held, self.start, self.at = b"", 0, 0

    @staticmethod
    def _inflated(content: bytes) -> Iterator[bytes]:
        at, view = 0, memoryview(content)
        while at < len(content):
            d = zlib.decompressobj(31)
            while not d.eof and at < len(content):
                piece = view[at : at + 65_536]
                try:
                    out = d.decompress(piece)
                except zlib.error:
                    return
                at += len(piece) - len(d.unused_data)
                yield out

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                self.held, self.start = self.held[self.start :] + part, 0
                return True
        return False

    def line(self) -> bytes:
        """The next line with its end; empty at the end."""
        seen = self.start
        while (end := self.held.find(b"\n", seen)) < 0:
            length = len(self.held) - self.start
            if not self._more():
                end = len(self.held) - 1
                break
            seen = length
        return self._cut(end + 1 - self.start)

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        if len(self.held) - self.start < n:
            held, size = [self.held[self.start :]], len(self.held) - self.start
            for part in self.parts:
                held.append(part)
                size += len(part)
                if size >= n:
                    break
            self.held, self.start = b"".join(held), 0
        return self._cut(n)

    def _cut(self, n: int) -> bytes:
        out = self.held[self.start : self.start + n]
        self.start += len(out)
        self.at += len(out)
        return out


def iso_date(date: str) -> str:
    """An ARC date (12 or 14 digits) as a WARC date; the epoch's start where it is none."""
    try:
        return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def header_key(head: bytes, name: str) -> int | None:
    """The integer (of 64 bits) in an HTTP header; None without one."""
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(-?\d{1,19})[ \t]*\r?$", head)
    return int(found[1]) if found and -(2**63) <= int(found[1]) < 2**63 else None


def arc_records(content: bytes, file: str, key_header: str = "X-Page-Id") -> Iterator[dict]:
    """The records of an ARC file.

    The version block says which of the two header lines follow. A record is as long as its header line declares; if the file ends before
    that it is marked as truncated. Bytes that no header line introduces are given as a record of the kind "resource", so nothing is lost.
    Kinds: warcinfo (the version block), response (HTTP), resource (anything else, such as DNS answers).
    """
    s, version = Stream(content), 1
    lost, lost_at = b"", 0

    def record(kind: str, offset: int, url: str, date: str, ip: str, mime: str, head: bytes, payload: bytes, truncated: bool) -> dict:
        return {"kind": kind, "file": file, "offset": offset, "key": header_key(head, key_header), "url": url, "date": iso_date(date), "ip": ip, "type": mime, "digest": sha1_base32(payload), "payload_bytes": len(payload), "truncated": truncated, "head": head, "payload": payload}

    while True:
        at, line = s.at, s.line()
        found = None
        if line.startswith(b"filedesc://"):
            found = HEADERS[2].fullmatch(line) or HEADERS[1].fullmatch(line)
        elif line.strip():
            found = HEADERS[version].fullmatch(line)
        if lost and (found or not line):
            yield record("resource", lost_at, f"{file}#{lost_at}", "", "", "application/octet-stream", b"", lost, False)
            lost = b""
        if not line:
            return
        if not found:
            if lost or line.strip():
                lost, lost_at = lost + line, lost_at if lost else at
            continue
        length, text = int(found["length"]), lambda name: found[name].decode("utf-8", "replace")  # noqa: B023
        block = s.take(length)
        cut = len(block) < length
        if line.startswith(b"filedesc://"):
            number = block.split(b" ", 1)[0]
            version = int(number) if number in (b"1", b"2") else 2 if b"Result-code" in block else 1
            yield record("warcinfo", at, text("url"), text("date"), text("ip"), text("type"), b"", block, cut)
        elif block.startswith(b"HTTP/") and re.match(rb"https?:", found["url"], re.IGNORECASE):
            end = HEAD_END.search(block)
            split = end.end() if end else len(block)
            yield record("response", at, text("url"), text("date"), text("ip"), text("type"), block[:split], block[split:], cut)
        else:
            yield record("resource", at, text("url"), text("date"), text("ip"), text("type"), b"", block, cut)


def _batched(rows: Iterator[dict], schema: pa.Schema, *large: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of rows and, but for one row, bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(r[c] or b"") for c in large)
        if size >= PORTION:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, key_header: str = "X-Page-Id", bodies: bool = True) -> DataFrame:
    """The records of all ARC files of a folder; without bodies, only what is known of them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = arc_records(content.as_py(), path_, key_header)
                yield from _batched(rows if bodies else (r | {"head": None, "payload": None} for r in rows), RECORD, "head", "payload")

    return _files(spark, path).mapInArrow(parse, RECORD_DDL)


def record_id(file: str, offset: int) -> str:
    """The same place in an archive always gets the same identifier, so a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def warc_record(r: dict) -> bytes:
    """A WARC record, without the two line ends that close it."""
    kind, head, payload = r["kind"], r["head"] or b"", r["payload"] or b""
    block, mime = head + payload, r["type"]
    if kind in ("response", "revisit"):
        mime = "application/http; msgtype=response"
    elif kind == "warcinfo":
        mime = "application/warc-fields"
        block = f"software: kalibra\r\nformat: WARC File Format 1.1\r\nconverted-from: {r['url']}\r\n".encode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(r["file"], r["offset"]), "WARC-Date": r["date"]}
    if kind != "warcinfo":
        fields |= {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"] if r["ip"] not in ("", "-", "0.0.0.0") else None, "WARC-Payload-Digest": f"sha1:{r['digest']}", "WARC-Payload-Length": r["payload_bytes"]}  # noqa: S104
    if r.get("to_file") is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(r["to_file"], r["to_offset"]), "WARC-Refers-To-Target-URI": r["to_url"], "WARC-Refers-To-Date": r["to_date"], "WARC-Refers-To-Key": r["to_key"]}
    if r["truncated"]:
        fields["WARC-Truncated"] = "unspecified"
    fields |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": mime or "application/octet-stream", "Content-Length": len(block)}
    lines = "".join(f"{k}: {re.sub('[\\r\\n]+', ' ', str(v))}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, key_header: str = "X-Page-Id", min_bytes: int = 0, file_bytes: int = 64 << 20) -> None:
    """Writes the ARC files of a folder as WARC files.

    Of HTTP records with equal payloads (length and SHA-1) of min_bytes or more, the one with the largest key (an integer that its HTTP header
    key_header has; by place in the archives where keys are equal, last where there is none) is a response, all others are revisits that name it;
    shorter ones are all responses. Only digests are grouped. Bodies stay where they were read, unless groups of copies are too
    many for a broadcast: then they are shuffled once, those of hot digests excepted, which are always broadcast.
    """
    index = saved(read_arc(spark, arc_path, key_header, bodies=False).drop("head", "payload"), "arc-index")
    n, size = index.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    own = index.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = F.max(F.struct("key", "file", "offset", "url", "date")).alias("first")
    groups = saved(own.groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1"), "arc-groups")
    hot = groups.where(F.col("n") > n // HOT_SHARE).select("digest", "payload_bytes", F.col("first").alias("hot"))
    rest = groups.where(F.col("n") <= n // HOT_SHARE).select(F.col("digest").alias("lookup"), F.col("payload_bytes").alias("lookup_bytes"), F.col("first").alias("rest"))
    grouped = (F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)
    records = read_arc(spark, arc_path, key_header).join(F.broadcast(hot), ["digest", "payload_bytes"], "left")
    # records that need no lookup are spread by their places
    records = records.withColumn("lookup", F.when(grouped & F.col("hot").isNull(), F.col("digest")).otherwise(F.concat_ws("#", "file", "offset")))
    records = records.join(rest.withColumnRenamed("lookup", "digest_").withColumnRenamed("lookup_bytes", "bytes_"), (F.col("lookup") == F.col("digest_")) & (F.col("payload_bytes") == F.col("bytes_")), "left")
    to = F.when(grouped, F.coalesce("hot", "rest"))
    records = records.withColumn("to", to).withColumn("to", F.when((F.col("to.file") != F.col("file")) | (F.col("to.offset") != F.col("offset")), F.col("to")))
    again = F.col("to").isNotNull()
    body = F.when(~again, F.col("payload"))
    records = records.select(F.when(again, F.lit("revisit")).otherwise(F.col("kind")).alias("kind"), "file", "offset", "key", "url", "date", "ip", "type", "digest", "payload_bytes", "truncated", "head", body.alias("payload"), *[F.col(f"to.{c}").alias(f"to_{c}") for c in ("key", "file", "offset", "url", "date")])
    per_file = max(2, int(file_bytes // ((size or 0) / max(n, 1) + 600)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            written = 0
            for b in batches:
                for r in b.to_pylist():
                    if r["kind"] == "warcinfo":
                        continue  # each new file gets its own
                    if written % per_file == 0:
                        yield {"record": warc_record(r | {"kind": "warcinfo", "url": r["file"], "offset": -1 - r["offset"], "to_file": None})}
                        written += 1
                    yield {"record": warc_record(r)}
                    written += 1

        yield from _batched(rows(), pa.schema([("record", pa.binary())]), "record")

    out = records.mapInArrow(write, "record binary").select(F.col("record").cast("string"))
    out.write.option("maxRecordsPerFile", per_file).text(warc_path, compression="gzip", lineSep="\r\n\r\n")


def warc_records(content: bytes, file: str, key_header: str = "X-Page-Id", blocks: bool = True) -> Iterator[dict]:
    """The records of a WARC file but for warcinfo; digests of payloads that are there are made anew and held against what the record says."""
    s = Stream(content)
    while True:
        at, line = s.at, s.line()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: no WARC record at {at}")
        fields = {}
        while (line := s.line()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = s.take(length)
        if len(block) < length:
            raise ValueError(f"{file}: the record at {at} breaks off")
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        end = HEAD_END.search(block) if "application/http" in fields["content-type"] else None
        split = end.end() if end else len(block) if "application/http" in fields["content-type"] else 0
        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
        if kind != "revisit" and (sha1_base32(block[split:]), length - split) != (digest, size):
            raise ValueError(f"{file}: the payload at {at} is not the one its record names")
        to = fields.get("warc-refers-to-key")
        yield {"record_id": fields["warc-record-id"], "record_type": kind, "url": fields["warc-target-uri"], "date": fields["warc-date"], "key": header_key(block[:split], key_header), "payload_bytes": size, "payload_digest": digest, "refers_to_id": fields.get("warc-refers-to"), "refers_to": int(to) if to else None, "block": block if blocks else None}


def read_warc(spark: SparkSession, path: str, key_header: str = "X-Page-Id", blocks: bool = True) -> DataFrame:
    """The records of all WARC files of a folder; a revisit names the record it refers to and that record's key."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batched(warc_records(content.as_py(), path_, key_header, blocks), READ, "block")

    return _files(spark, path).mapInArrow(parse, READ_DDL)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = "20000101000000", key_header: str = "X-Page-Id", file_bytes: int = 64 << 20, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes pages as ARC files, of each of the versions in turn; a page's id goes into its HTTP header.

    A null html is an empty body, a null id leaves the header out, a null url is `http://invalid/`. White space and control characters
    of URLs are percent-encoded, as a header line can't hold them; a URL without http or https gets `http://invalid/` before it. Other columns
    are not read; rows that repeat are records each. An empty table gives no records.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"))
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(html))).first()
    per_file = max(2, int(file_bytes // ((size or 0) / max(n, 1) + 300)))

    def line(version: int, place: tuple, checksum: str, offset: int, name: str, length: int) -> bytes:
        more = () if version == 1 else ("200", checksum, "-", str(offset), name)
        return (" ".join([*place, *more, str(length)]) + "\n").encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records() -> Iterator[dict]:
            written, at, name, version = 0, 0, "", 1
            for b in batches:
                for r in b.to_pylist():
                    if written % per_file == 0:
                        name, version, at = f"part-{part:05}-{written // per_file:03}.arc", versions[(part + written // per_file) % len(versions)], 0
                        body = f"{version} 0 kalibra\n{FIELDS[version]}\n\n".encode()  # the writer adds the last line end
                        own = line(version, (f"filedesc://{name}", "0.0.0.0", date, "text/plain"), "-", 0, name, len(body)) + body[:-1]  # noqa: S104
                        yield {"record": own}
                        written, at = written + 1, len(own) + 1
                    place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "")
                    place = place if re.match("https?:", place, re.IGNORECASE) else f"http://invalid/{place}"
                    key = "" if r["id"] is None else f"{key_header}: {r['id']}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(r['html'])}\r\n\r\n".encode() + r["html"]
                    own = line(version, (place, "0.0.0.0", date, "text/html"), hashlib.md5(block).hexdigest() if version == 2 else "", at, name, len(block)) + block  # noqa: S104, S324
                    yield {"record": own}
                    written, at = written + 1, at + len(own) + 1

        yield from _batched(records(), pa.schema([("record", pa.binary())]), "record")

    out = rows.mapInArrow(write, "record binary").select(F.col("record").cast("string"))
    out.write.option("maxRecordsPerFile", per_file).text(path, compression="gzip", lineSep="\n")
