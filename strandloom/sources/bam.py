"""BAM files as a data source: ``spark.read.format("bam").load(path)``.

A BAM file is a chain of gzip blocks that each name their length, so block starts are found
without inflating.  The driver cuts a file into spans of blocks; records may straddle blocks,
so a span reads on into the next until its last record is whole, and it starts at the first
offset from which records parse as a chain.  Register with ``register(spark)``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, chrom string, pos0 long, mapq int, cigar string, nh int, de double, nm int, qlen int"
SPAN = 32 << 20
_OPS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_KINDS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def block_size(head: bytes) -> int:
    """Length of the block that starts with these 18 bytes or more."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a block of a BAM file")
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at < 12 + extra:
        a, b, n = struct.unpack_from("<BBH", head, at)
        if (a, b) == (66, 67):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("block without length")


def blocks(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the inflated blocks from a block start on."""
    f.seek(start)
    while head := f.read(18):
        size = block_size(head)
        data = head + f.read(size - 18)
        yield start, zlib.decompress(data, 31)
        start += size


def header(f) -> tuple[list[str], int]:
    """Reference names, and how many inflated bytes the header has."""
    data, source = b"", blocks(f, 0)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            data += next(source)[1]

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    (text,) = struct.unpack_from("<i", data, 4)
    need(12 + text)
    (n,) = struct.unpack_from("<i", data, 8 + text)
    at, names = 12 + text, []
    for _ in range(n):
        need(at + 4)
        (size,) = struct.unpack_from("<i", data, at)
        need(at + 8 + size)
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    return names, at


def record(data: bytes, names: list[str]) -> tuple:
    """One record without its length field."""
    ref, pos, name_len, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32
    qname = data[at : at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops + (n_seq + 1) // 2 + n_seq
    tags: dict[str, float] = {}
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            sub, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + count * _SIZES[sub]
        else:
            if kind in _KINDS:
                (tags[tag],) = struct.unpack_from("<" + _KINDS[kind], data, at)
            at += _SIZES[kind]
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    return qname, flag, names[ref] if 0 <= ref < len(names) else None, pos, mapq, cigar, tags.get("NH"), tags.get("de"), tags.get("NM"), n_seq


def _plausible(data: bytes, at: int, refs: int) -> bool | None:
    """Whether a record can start here; None if the bytes end first."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name_len, _, _, n_ops, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and name_len >= 1 and 0 <= n_seq):
        return False
    if size < 32 + name_len + 4 * n_ops + (n_seq + 1) // 2 + n_seq or size > 1 << 28:
        return False
    if at + 36 + name_len > len(data):
        return None
    name = data[at + 36 : at + 36 + name_len]
    return name[-1] == 0 and 0 not in name[:-1] and all(33 <= c <= 126 for c in name[:-1])


def first_record(data: bytes, refs: int, chain: int = 4) -> int:
    """Least offset from which ``chain`` records, or all up to the end, follow one another."""
    for start in range(len(data)):
        at, good = start, 0
        while good < chain:
            ok = _plausible(data, at, refs)
            if ok is None:
                return start
            if not ok:
                break
            good += 1
            at += 4 + struct.unpack_from("<i", data, at)[0]
            if at >= len(data):
                return start
        if good >= chain:
            return start
    return len(data)


class Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int, skip: int | None, names: list[str]):
        self.path, self.start, self.stop, self.skip, self.names = path, start, stop, skip, names


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",")
        self.span = int(options.get("span", SPAN))

    def partitions(self) -> list[Span]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                names, skip = header(f)
                start = at = 0
                first = True
                f.seek(0)
                while head := f.read(18):
                    at += block_size(head)
                    f.seek(at)
                    if at - start >= self.span:
                        out.append(Span(path, start, at, skip if first else None, names))
                        start, first = at, False
                if at > start:
                    out.append(Span(path, start, at, skip if first else None, names))
        return out

    def read(self, part: Span) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            data, extra = [], []
            for at, block in blocks(f, part.start):
                (data if at < part.stop else extra).append(block)
                if at >= part.stop and sum(map(len, extra)) > 1 << 16:
                    break
            own = b"".join(data)
            text = own + b"".join(extra)
            at = part.skip if part.skip is not None else first_record(text, len(part.names))
            while at < len(own):
                while at + 4 > len(text) or at + 4 + struct.unpack_from("<i", text, at)[0] > len(text):
                    more = [b for _, b in blocks(f, self._after(f, part, len(text)))]
                    if not more:
                        raise ValueError(f"{part.path}: truncated")
                    text += b"".join(more)
                (size,) = struct.unpack_from("<i", text, at)
                yield record(text[at + 4 : at + 4 + size], part.names)
                at += 4 + size

    @staticmethod
    def _after(f, part: Span, have: int) -> int:
        """Offset of the first block of which nothing is in the ``have`` inflated bytes."""
        seen = 0
        for at, block in blocks(f, part.start):
            if seen >= have:
                return at
            seen += len(block)
        f.seek(0, 2)
        return f.tell()


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def write_bam(path: str, references: list[tuple[str, int]], records: list[tuple], block: int = 60_000) -> None:
    """A small BAM writer for fixtures and exports: (qname, flag, chrom, pos0, mapq, cigar, seq_len, tags)."""
    text = b"@HD\tVN:1.6\n"
    out = [b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in references]
    index = {n: k for k, (n, _) in enumerate(references)}
    for qname, flag, chrom, pos0, mapq, cigar, n, tags in records:
        ops = [int(c) << 4 | _OPS.index(o) for c, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        body = struct.pack("<iiBBHHHiiii", index.get(chrom, -1), pos0, len(qname) + 1, mapq, 0, len(ops), flag, n, -1, -1, 0) + qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + b"\x11" * ((n + 1) // 2) + b"\xff" * n
        for tag, value in tags.items():
            body += tag.encode() + (b"f" + struct.pack("<f", value) if isinstance(value, float) else b"i" + struct.pack("<i", value))
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    with open(path, "wb") as f:
        for at in [*range(0, len(data), block), None]:
            raw = b"" if at is None else data[at : at + block]
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = c.compress(raw) + c.flush()
            f.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(raw), len(raw)))
