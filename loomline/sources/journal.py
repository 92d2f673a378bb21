"""Binary link journals: files to ordered operation rows, and rows to files.

One task reads one file at a time. A file without the signature gives one error row; damage later on ends that file's
rows with an error row, and the operations before the damage stay.
"""

from __future__ import annotations

import struct
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: signature, and header size (signature, 8-byte tag, 4 reserved bytes).
SIGNATURE, HEADER = b"GZZ0", 16
SCHEMA = "file string, block_idx int, stamp long, op_idx int, kind string, a string, b string, error string"


def java_text(raw: bytes) -> str:
    """Java's modified UTF-8: NUL is C0 80, and a supplementary character is its two surrogates, three bytes each.

    Bytes are read into 16-bit units, which are UTF-16 in the end; what isn't well formed is replaced.
    """
    units, at = array("H"), 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 0
        rest = raw[at + 1 : at + size]
        if size == 0 or len(rest) != size - 1 or any(b >> 6 != 2 for b in rest):
            units.append(0xFFFD)
            at += 1
            continue
        unit = lead if size == 1 else lead & 0xFF >> size + 1
        for b in rest:
            unit = unit << 6 | b & 0x3F
        units.append(unit)
        at += size
    return units.tobytes().decode(f"utf-16-{sys.byteorder[0]}e", "replace")


def java_bytes(text: str) -> bytes:
    units = text.encode("utf-16-le")
    raw = "".join(chr(int.from_bytes(units[k : k + 2], "little")) for k in range(0, len(units), 2)).encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")
    return struct.pack(">H", len(raw)) + raw


def _strings(data: bytes, at: int, end: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        if at + 2 > end or at + 2 + (size := int.from_bytes(data[at : at + 2], "big")) > end:
            raise ValueError(f"data ends at byte {at}")
        out.append(java_text(data[at + 2 : at + 2 + size]))
        at += 2 + size
    return out, at


def decode(data: bytes) -> Iterator[tuple]:
    """(block_idx, stamp, op_idx, kind, a, b, error); errors come as a last row of their own."""
    if len(data) < HEADER or data[:4] != SIGNATURE:
        yield None, None, None, None, None, None, "no journal header"
        return
    at, block, stamp = HEADER, 0, None
    try:
        while at < len(data):
            if data[at : at + 1] != b"t" or at + 9 > len(data):
                raise ValueError(f"no whole block header at byte {at}")
            stamp, size = struct.unpack(">II", data[at + 1 : at + 9])
            at, op = at + 9, 0
            stop = at + size
            end = min(stop, len(data))
            while at < end:
                code = data[at : at + 1]
                if code == b"d":
                    if data[at + 1 : at + 2] not in (b"+", b"-"):
                        raise ValueError(f"no direction at byte {at + 1}")
                    kind, n, at = "d" + chr(data[at + 1]), 1, at + 2
                elif code in (b"c", b"s"):
                    kind, n, at = code.decode(), 2, at + 1
                else:
                    raise ValueError(f"unknown operation at byte {at}")
                found, at = _strings(data, at, end, n)
                yield block, stamp, op, kind, found[0], found[1] if n == 2 else None, None
                op += 1
            if stop > len(data):
                raise ValueError(f"block {block} ends {stop - len(data)} bytes after the file")
            block += 1
    except ValueError as broken:
        yield block, stamp, None, None, None, None, str(broken)


def encode(blocks: list[tuple[int, list[tuple[str, str, str | None]]]], tag: int = 0) -> bytes:
    out = [SIGNATURE, struct.pack(">QI", tag, 0)]
    for stamp, ops in blocks:
        body = b"".join(kind.encode() + java_bytes(a) + (java_bytes(b or "") if kind in "cs" else b"") for kind, a, b in ops)
        out += [b"t", struct.pack(">II", stamp, len(body)), body]
    return b"".join(out)


def operations(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["file", "block_idx", "stamp", "op_idx", "kind", "a", "b", "error"]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, *r) for r in decode(content.as_py() or b"")]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    return operations(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def in_order(ops: DataFrame) -> DataFrame:
    """With ``seq``, the order in which a replay applies them: within a block disconnects, then connects, then texts."""
    rank = F.when(F.col("kind").isin("d+", "d-"), 0).when(F.col("kind") == "c", 1).otherwise(2)
    return ops.filter("error IS NULL").withColumn("seq", F.struct("block_idx", rank.alias("kind_rank"), "op_idx"))
