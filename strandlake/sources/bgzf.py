"""Blocked gzip files and their tabix indexes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

from strandlake.operators.pileup import COLUMNS
from strandlake.sources import files
from strandlake.sources.formats import plain_number

#: Block header up to the extra field's size, the empty last block, most bytes of text in a block.
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_BYTES = 65280


class BgzfError(ValueError):
    """Not a blocked gzip file, or a damaged one."""


def compress_block(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return _HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def read_block(f: BinaryIO) -> bytes | None:
    """The next block's text; None at the end of the file."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != _HEAD[:4]:
        raise BgzfError("not a BGZF block")
    (extra_size,) = struct.unpack("<H", head[10:12])
    extra, at, size = f.read(extra_size), 0, None
    while at + 4 <= len(extra):
        tag, (n,) = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])
        if tag == b"BC":
            (size,) = struct.unpack("<H", extra[at + 4 : at + 6])
        at += 4 + n
    if size is None:
        raise BgzfError("a gzip member without a block size")
    body = f.read(size + 1 - 12 - extra_size)
    text = zlib.decompress(body[:-8], -15)
    if zlib.crc32(text) != struct.unpack("<I", body[-8:-4])[0]:
        raise BgzfError("damaged block")
    return text


class BgzfReader:
    """Bytes of a BGZF file from a virtual offset (block start << 16 | place in the block)."""

    def __init__(self, f: BinaryIO, virtual: int = 0) -> None:
        self.f = f
        f.seek(virtual >> 16)
        self.start = virtual >> 16
        self.block = read_block(f) or b""
        self.at = virtual & 0xFFFF

    def tell(self) -> int:
        if self.at >= len(self.block):
            self._next()
        return self.start << 16 | self.at

    def _next(self) -> bool:
        while True:
            self.start = self.f.tell()
            block = read_block(self.f)
            self.block, self.at = block or b"", 0
            if block is None or block:
                return bool(block)

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at >= len(self.block) and not self._next():
                break
            part = self.block[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def lines(self, end: int | None = None) -> Iterator[tuple[int, str]]:
        """(virtual offset, line) up to the virtual offset ``end``."""
        rest = b""
        while True:
            where = self.tell() if not rest else where  # noqa: F821
            if end is not None and not rest and where >= end:
                return
            cut = self.block.find(b"\n", self.at)
            if cut < 0:
                rest += self.block[self.at :]
                self.at = len(self.block)
                if not self._next():
                    if rest:
                        yield where, rest.decode()
                    return
                continue
            line = rest + self.block[self.at : cut]
            self.at, rest = cut + 1, b""
            yield where, line.decode()


def region_bin(beg: int, end: int) -> int:
    """Bin of a region in the index's tree of 16 kb to 512 Mb intervals."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


_TEXT = ("contig", "mod_type", "strand", "color")


def record_line(line: str) -> str:
    """A pileup line in the one form that is written: 18 fields, whole numbers without signs and zeros in front, the fraction in shortest decimals.

    A line that isn't a record is an error.
    """
    fields = line.rstrip("\r\n").split("\t")
    if len(fields) != len(COLUMNS):
        raise BgzfError(f"a pileup line has {len(COLUMNS)} fields, this one {len(fields)}: {line[:80]!r}")
    out = []
    for name, value in zip(COLUMNS, fields):
        value = value.strip()
        try:
            out.append(value if name in _TEXT else plain_number(float(value)) if name == "fraction_modified" else str(_whole(value)))
        except ValueError:
            raise BgzfError(f"{name} of a pileup line can't be '{value}'") from None
    return "\t".join(out)


def _whole(value: str) -> int:
    n = int(value)
    if n < 0:
        raise ValueError(value)
    return n


class PileupWriter:
    """Writes tab-separated pileup lines, as they stand, as BGZF with a tabix index beside the file.

    Lines of a contig must come together and sorted by start, as the index
    needs. ``finish`` writes the index; later calls do nothing.
    """

    def __init__(self, path: str | Path, force: bool = False) -> None:
        self.path = str(path)
        if files.exists(self.path) and not force:
            raise FileExistsError(f"{self.path} exists; use force to replace it")
        self.f = files.open_write(self.path)
        self.buffer, self.done = b"", False
        self.names: list[str] = []
        self.chunks: list[dict[int, list[list[int]]]] = []
        self.linear: list[dict[int, int]] = []

    def form(self, line: str) -> str:
        """The line as it is written."""
        return line

    def _tell(self) -> int:
        return self.f.tell() << 16 | len(self.buffer)

    def write_lines(self, lines) -> None:
        if self.done:
            return
        for line in lines:
            line = line.rstrip("\n")
            if not line.strip():
                continue
            line = self.form(line)
            contig, beg, end = line.split("\t", 3)[:3]
            data = line.encode() + b"\n"
            if len(self.buffer) + len(data) > MOST_BYTES:
                self._flush()
            at = self._tell()
            self._enter(contig)
            self.buffer += data
            while len(self.buffer) > MOST_BYTES:
                block, self.buffer = self.buffer[:MOST_BYTES], self.buffer[MOST_BYTES:]
                self.f.write(compress_block(block))
            b, e = int(beg), max(int(end), int(beg) + 1)
            spans = self.chunks[-1].setdefault(region_bin(b, e), [])
            if spans and spans[-1][1] == at:
                spans[-1][1] = self._tell()
            else:
                spans.append([at, self._tell()])
            for w in range(b >> 14, (e - 1 >> 14) + 1):
                self.linear[-1].setdefault(w, at)

    def _enter(self, contig: str) -> None:
        """Index what comes next under this contig."""
        if not self.names or self.names[-1] != contig:
            if contig in self.names:
                raise BgzfError(f"rows of contig '{contig}' don't lie together")
            self.names.append(contig)
            self.chunks.append({})
            self.linear.append({})

    @property
    def index(self) -> tuple[list[str], list[dict], list[dict]]:
        """Contigs, chunks by bin and linear offsets of the lines so far, as ``append`` takes them."""
        return self.names, self.chunks, self.linear

    def append(self, path: str, index: tuple[list[str], list[dict], list[dict]]) -> None:
        """Add the blocks of a finished file as they stand; the offsets of its index move along.

        Its lines must follow those before as lines of ``write_lines`` do.
        """
        self._flush()
        moved, left = self.f.tell() << 16, files.size_of(path) - len(END_BLOCK)
        with files.open_read(path) as f:
            while left > 0:
                data = f.read(min(left, 1 << 20))
                if not data:
                    raise BgzfError(f"{path} is cut short")
                self.f.write(data)
                left -= len(data)
        for contig, bins, linear in zip(*index):
            self._enter(contig)
            for b, spans in bins.items():
                self.chunks[-1].setdefault(b, []).extend([begin + moved, end + moved] for begin, end in spans)
            for w, at in linear.items():
                self.linear[-1].setdefault(w, at + moved)

    def _flush(self) -> None:
        if self.buffer:
            self.f.write(compress_block(self.buffer))
            self.buffer = b""

    def finish(self) -> None:
        if self.done:
            return
        self.done = True
        self._flush()
        self.f.write(END_BLOCK)
        self.f.close()
        names = b"".join(n.encode() + b"\0" for n in self.names)
        # format 0x10000: columns 1, 2, 3 hold contig, 0-based start and end; '#' begins comments
        out = b"TBI\1" + struct.pack("<8i", len(self.names), 0x10000, 1, 2, 3, ord("#"), 0, len(names)) + names
        for bins, linear in zip(self.chunks, self.linear):
            out += struct.pack("<i", len(bins))
            for b, spans in sorted(bins.items()):
                out += struct.pack("<Ii", b, len(spans)) + b"".join(struct.pack("<QQ", *s) for s in spans)
            n, last = max(linear, default=-1) + 1, 0
            out += struct.pack("<i", n)
            for w in range(n):
                last = linear.get(w, last)
                out += struct.pack("<Q", last)
        blocks = [out[i : i + MOST_BYTES] for i in range(0, len(out), MOST_BYTES)]
        with files.open_write(f"{self.path}.tbi") as f:
            f.write(b"".join(map(compress_block, blocks)) + END_BLOCK)

    def __enter__(self) -> PileupWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.finish()


class RecordWriter(PileupWriter):
    """The same for lines of any source: each is parsed and rendered anew (``record_line``)."""

    def form(self, line: str) -> str:
        return record_line(line)


def _indexed(path: str | Path) -> Iterator[tuple[str, list[tuple[int, int]], list[int]]]:
    """(contig, chunks, linear offsets) of a tabix index, all virtual; contigs without rows are left out."""
    with files.open_read(f"{path}.tbi") as f:
        data = b""
        while (block := read_block(f)) is not None:
            data += block
    if data[:4] != b"TBI\1":
        raise BgzfError("not a tabix index")
    n, *_, size = struct.unpack("<8i", data[4:36])
    names, at = data[36 : 36 + size].split(b"\0"), 36 + size
    for name in names[:n]:
        (n_bins,) = struct.unpack_from("<i", data, at)
        at += 4
        spans = []
        for _ in range(n_bins):
            b, n_chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if b != 37450:  # the bin that holds counts
                spans += [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(n_chunks)]
            at += 16 * n_chunks
        (n_linear,) = struct.unpack_from("<i", data, at)
        linear = list(struct.unpack_from(f"<{n_linear}Q", data, at + 4))
        at += 4 + 8 * n_linear
        if spans:
            yield name.decode(), spans, linear


def read_index(path: str | Path) -> dict[str, tuple[int, int]]:
    """Per contig of a tabix index the virtual offsets where its rows begin and end."""
    return {name: (min(s[0] for s in spans), max(s[1] for s in spans)) for name, spans, _ in _indexed(path)}


def index_parts(path: str | Path, least_bytes: int) -> dict[str, list[tuple[int, int]]]:
    """The same cut into parts, each of at least ``least_bytes`` of the file but the last.

    Cuts lie where the index has a chunk or a linear interval begin, so every
    line is in one part.
    """
    out = {}
    for name, spans, linear in _indexed(path):
        first, last = min(s[0] for s in spans), max(s[1] for s in spans)
        ends = [first]
        for cut in sorted({s[0] for s in spans} | set(linear)):
            if first < cut < last and (cut >> 16) - (ends[-1] >> 16) >= least_bytes:
                ends.append(cut)
        out[name] = list(zip(ends, [*ends[1:], last]))
    return out
