"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC back to rows.

An ARC file opens with a version block that says which fields its header lines have; each record is such a line, the
declared number of bytes, and a line feed. The converter parses both versions by the declared fields and lengths and
synthesises what ARC lacks: record identifiers (named by digest and page), ISO timestamps, record types, and SHA-1
digests in base 32. Records whose payload another record keeps become revisits that refer to it and carry only the HTTP
header. Archives are written by Spark as files of bounded size, each record a gzip member of its own (so that other readers can
seek), and read back with ``binaryFile``. Archives from elsewhere may have one member for all records, one a record, or
none; their headers are read as far as they make sense and never end a job.

Defined cases: a null html is an empty payload; a null url is ``-``, and white space in urls is percent-encoded; very
long payloads get an archive of their own; of equal payloads the largest page_id keeps the response (a null page_id is
smaller than any other; rows that tie on the largest page_id are all responses); an empty table gives no archives and no
rows; a record that is cut off is read as far as it goes and flagged (WARC-Truncated); one whose header line is short, has
no length or isn't finished, and a file without its opening, give a record with its WARC-Problem. A gzip file that is
cut off or damaged is read up to there, and a row without type has the ``problem``. Reading WARC, bytes that aren't UTF-8 are
replaced; a missing field is null; an X-Page-Id that isn't a number of 64 bits is no page_id, and its row has the
``problem``; so has a record without a length (it takes the rest), one that the file ends in, and bytes between records that are
no record (a row without type). Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import slices
from loomline.storage import materialise, shared_path

ARCHIVE_BYTES = 32 << 20
#: Up to so many revisits are broadcast to mark the pages; beyond, the pages are joined by a shuffle.
BROADCAST_ROWS = 500_000
END = b"\r\n\r\n"
#: Bytes that are unpacked at a time, and the level of compression.
CHUNK, LEVEL = 1 << 20, 6

# Fixed values of the formats: the fields of ARC header lines by version, and the profile of revisits by digest.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    cut_off: bool = False
    problem: str | None = None

    @property
    def parts(self) -> tuple[bytes, bytes]:
        """HTTP header with its empty line, and payload; a block without such a header is all payload."""
        at = self.block.find(END)
        if not self.block.startswith(b"HTTP/") or at < 0:
            return b"", self.block
        return self.block[: at + 4], self.block[at + 4 :]


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    if not url:
        return "-"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def arc_open(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 Loomline\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, url: str | None, date: str, block: bytes, offset: int, name: str) -> bytes:
    fields = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file in order, by its own field list and the declared lengths; never raises.

    Where a header line has too few fields or no number for its length, nothing tells where the next record begins: one
    record with a ``problem`` takes what is left and is the last. A header line that the file ends in has a problem and
    an empty block; a block that it ends in is cut off.
    """
    line_end = data.find(b"\n")
    opening = data[: max(line_end, 0)].decode("utf-8", "replace").rstrip("\r").split(" ")
    length = whole_number(opening[-1])
    if not data.startswith(b"filedesc://") or length is None or length < 0:
        yield ArcRecord(0, "-", "-", "", "-", data, problem="no filedesc record opens the file")
        return
    at = line_end + 1 + length
    lines = data[line_end + 1 : at].decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields = lines[1].split(" ") if len(lines) > 1 else []
    if "Archive-length" not in fields:
        yield ArcRecord(0, "-", "-", "", "-", data[line_end + 1 :], problem="the version block has no list of fields")
        return
    version = whole_number(lines[0].split(" ")[0]) or 0
    while at < len(data):
        line_end = data.find(b"\n", at)
        head = data[at : line_end if line_end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if line_end >= 0 and not head:  # an empty line between records
            at = line_end + 1
            continue
        line = head.split(" ")
        if len(line) > len(fields):  # blanks in the URL, which comes first
            line = [" ".join(line[: len(line) - len(fields) + 1]), *line[len(line) - len(fields) + 1 :]]
        told = dict(zip(fields, line, strict=False))
        common = (version, told.get("URL", "-"), told.get("IP-address", "-"), told.get("Archive-date", ""), told.get("Content-type", "-"))
        if line_end < 0:
            yield ArcRecord(*common, b"", True, "the file ends in a header line")
            return
        length = whole_number(told.get("Archive-length"))
        if length is None or length < 0:
            yield ArcRecord(*common, data[line_end + 1 :], problem=f"no length in the header line {head[:200]!r}")
            return
        block = data[line_end + 1 : line_end + 1 + length]
        yield ArcRecord(*common, block, len(block) < length)
        at = line_end + 1 + length + 1


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def iso_date(date: str) -> str:
    """ARC's fourteen (in old files twelve or eight) digits as an ISO instant; what isn't digits as the first day of year 1."""
    digits = date if date.isascii() and date.isdigit() else ""
    d = (digits + "00010101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_field(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n"):
        if line.lower().startswith(name.lower() + b":"):
            return line.split(b":", 1)[1].strip().decode("utf-8", "replace")
    return None


def whole_number(text: str | None) -> int | None:
    """A decimal number of 64 bits, else None."""
    if text is None or not text.isascii() or not text.removeprefix("-").isdecimal() or len(text) > 20 or not -(1 << 63) <= int(text) < 1 << 63:
        return None
    return int(text)


def warc_record(arc: ArcRecord, refers_to: str | None) -> bytes:
    """The equivalent WARC record without its last four bytes; with ``refers_to`` (a page) it is a revisit."""
    header, payload = arc.parts
    digest, page = digest32(payload), http_field(header, b"X-Page-Id") or "-"
    block = header if refers_to is not None else arc.block
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", iso_date(arc.date)),
        ("WARC-Target-URI", arc.url),
        ("WARC-IP-Address", arc.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if header else arc.mime),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    if arc.cut_off:
        fields.append(("WARC-Truncated", "length"))
    if arc.problem:
        fields.append(("WARC-Problem", arc.problem))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def _named(head: bytes) -> dict[str, str]:
    """Fields of a header's lines after the first, by lower-case name; a line that begins with a blank continues the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif colon:
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of every record, with ``problem`` where something is amiss; never raises."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        if not data.startswith(b"WARC/", at):
            stop = data.find(b"\nWARC/", at)
            stop = len(data) if stop < 0 else stop + 1
            yield {"problem": "no record begins here"}, data[at:stop]
            at = stop
            continue
        stop = data.find(END, at)
        if stop < 0:
            yield _named(data[at:]) | {"problem": "the file ends in a header"}, b""
            return
        fields = _named(data[at:stop])
        length = whole_number(fields.get("content-length"))
        if length is None or length < 0:
            yield fields | {"problem": "no length in the header"}, data[stop + 4 :]
            return
        block = data[stop + 4 : stop + 4 + length]
        yield (fields if len(block) == length else fields | {"problem": "the file ends in a record"}), block
        at = stop + 4 + length


def _archives(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records to archives of about ARCHIVE_BYTES, one row each; every record is a gzip member, and the last byte of a row is zero."""

    def row(members: list[bytes]) -> pa.RecordBatch:
        if members[-1][-1]:  # a member ends in its length, whose highest byte is zero but for records of 16 MB
            members.append(gzip.compress(b"", mtime=0))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["content"])

    held, size = [], 0
    for record in records:
        if held and size + len(record) > ARCHIVE_BYTES:
            yield row(held)
            held, size = [], 0
        held.append(gzip.compress(record + END, LEVEL, mtime=0))
        size += len(record) + 4
    if held:
        yield row(held)


def write_archives(archives: DataFrame, path: str) -> None:
    """Each row becomes one file under ``path``. The row's last byte, a zero, is written as the line's end."""
    content = F.expr("substring(content, 1, octet_length(content) - 1)").cast("string").alias("value")
    archives.select(content).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _page_arc(batch: pa.RecordBatch, number: int) -> bytes:
    """A batch of pages as an ARC file, versions 1 and 2 in turn."""
    version, name, date = 1 + number % 2, f"pages-{number}.arc", "20240101000000"
    out, size = [arc_open(version, name, date)], 0
    for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        page = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}\r\n{html or ''}".encode()
        out.append(arc_record(version, url, date, block, size, name))
        size += len(out[-1])
    return b"".join(out)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of larger id keeps."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).filter(F.col("size") >= least_bytes).drop("size")
    kept = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    return small.join(_sized(materialise(kept, "kept")), "digest").filter("NOT page_id <=> refers_to").distinct()


def _sized(df: DataFrame) -> DataFrame:
    """``df``, which was written before, to be broadcast where its counted rows allow it: then no key is shuffled, however frequent."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pages_to_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Pages as legacy ARC records, converted to WARC archives under ``path``."""
    again = materialise(revisits(pages, least_bytes), "revisits")
    again = again.select(F.struct("page_id", "digest").alias("same"), "refers_to")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = marked.withColumn("mine", F.struct("page_id", F.sha1(F.col("html").cast("binary")).alias("digest")))
    marked = marked.join(_sized(again), F.col("mine").eqNullSafe(F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            number = 0
            for whole in batches:
                for batch in slices(whole, 2):
                    for arc, refers in zip(parse_arc(_page_arc(batch, number)), batch.column(3).to_pylist(), strict=True):
                        yield warc_record(arc, None if refers is None else str(refers))
                    number += 1

        return _archives(records())

    write_archives(marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "content binary"), path)


def convert_arc(spark: SparkSession, source: str, path: str) -> None:
    """ARC files (plain or gzip) under ``source`` to WARC archives under ``path``, all as responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(record for batch in batches for content in batch.column(0) for record in _converted(content.as_py()))

    write_archives(spark.read.format("binaryFile").load(source).select("content").mapInArrow(run, "content binary"), path)


def unpack(content: bytes) -> tuple[bytes, str | None]:
    """A file's bytes, all gzip members unpacked one after the other, and what ended that early; zeros behind the last member are padding."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out, rest = [], memoryview(content)
    while len(rest):
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(rest), CHUNK):
                out.append(member.decompress(rest[at : at + CHUNK]))
                if member.eof:
                    break
        except zlib.error:
            return b"".join(out), "the gzip file is damaged"
        if not member.eof:
            return b"".join(out), "the gzip file is cut off"
        rest = rest[min(at + CHUNK, len(rest)) - len(member.unused_data) :]
        if len(rest) and bytes(rest[:2]) != b"\x1f\x8b":
            return b"".join(out), None if not bytes(rest).strip(b"\0") else "bytes behind the last gzip member"
    return b"".join(out), None


def _converted(content: bytes) -> Iterator[bytes]:
    """The WARC records of an ARC file; what ended its unpacking is told by its last one."""
    data, amiss = unpack(content)
    before = None
    for arc in parse_arc(data):
        if before:
            yield warc_record(before, None)
        before = arc
    if before or amiss:
        before = before or ArcRecord(0, "-", "-", "", "-", b"")
        before.problem = "; ".join(x for x in (before.problem, amiss) if x) or None
        yield warc_record(before, None)


READ = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to_id string, payload_digest string, payload_bytes long, problem string, payload binary"


def _read(content: bytes, with_payload: bool) -> Iterator[tuple]:
    """Rows of READ of one archive."""
    data, amiss = unpack(content)
    rows = []
    for fields, block in parse_warc(data):
        at = block.find(END)
        header, payload = (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)
        told, kind = http_field(header, b"X-Page-Id"), fields.get("warc-type")
        page, again = whole_number(told), kind == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None if again else digest32(payload)
        problem = fields.get("problem") or fields.get("warc-problem") or ("X-Page-Id is no number" if told is not None and page is None else None)
        named = (fields.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date"))
        rows.append((*named, page, fields.get("warc-refers-to"), digest, None if again else len(payload), problem, payload if with_payload else None))
    if amiss:
        rows.append((None,) * 8 + (amiss, None))
    return iter(rows)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """record_id, record_type, target_uri, date, page_id, refers_to_id, payload_digest, payload_bytes and problem of every record.

    Digest and length of a response are those of the payload that was read; a revisit has its digest from the record
    and no length. ``with_payload`` adds the payload itself.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*_read(content.as_py(), with_payload), strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)
    return rows if with_payload else rows.drop("payload")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page): revisits take both from their response."""
    records = materialise(records.select("record_id", "record_type", "page_id", "refers_to_id", "payload_digest", "payload_bytes"), "records")
    responses = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'")
    asked = again.select(F.col("refers_to_id").alias("record_id")).distinct()
    kept = responses.join(asked, "record_id").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"))
    again = again.join(_sized(materialise(kept, "kept")), "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(again.withColumn("payload_bytes", F.col("bytes")).select(columns))


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as WARC archives to the shared folder, and read back."""
    path = shared_path(pages.sparkSession, "warc")
    pages_to_warc(pages, path, least_bytes)
    return resolve_revisits(read_warc(pages.sparkSession, path))
