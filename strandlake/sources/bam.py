"""BAM files as a data source.

``spark.read.format("strandlake_bam").load(path)`` gives one row per record. A
file with an index (``.bai``) is read by one partition per reference and one for
the unplaced rest, others by one partition per file. With ``option("full",
"true")`` a row has all that a record holds, so that it can be written again.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import files
from strandlake.sources.bgzf import END_BLOCK, MOST_BYTES, BgzfReader, compress_block, region_bin

SCHEMA = "read_id string, flag int, contig string, start int, mapq int, cigar string, strand string, seq string, mm string, ml array<int>"
#: Base qualities (Phred + 33, as the sequence in original orientation), the mate's place, the template's length and all tags but MM and ML as they stand in the file.
FULL = SCHEMA + ", qual string, mate_contig string, mate_start int, template_length int, tags binary"
#: Bases by their four bits, CIGAR operations by code, number formats and sizes of tag values by type.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN=", "TGCAYRSWMKVHDBN=")


class BamError(ValueError):
    """Not a BAM file, or a damaged one."""


def read_header(r: BgzfReader) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the references."""
    if r.read(4) != b"BAM\1":
        raise BamError("not a BAM file")
    text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", r.read(4))[0]):
        name = r.read(struct.unpack("<i", r.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", r.read(4))[0]))
    return text, refs


def reference_names(path: str) -> list[str]:
    return [n for n, _ in header_of(path)[1]]


def header_of(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references of a file."""
    with files.open_read(path) as f:
        return read_header(BgzfReader(f))


def _tags(data: bytes) -> Iterator[tuple[str, str, object, bytes]]:
    """(tag, type, value, its bytes) of each tag; values of strings, byte arrays, characters and numbers."""
    at = 0
    while at + 3 <= len(data):
        begin, tag, kind = at, data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            size = _SIZES[sub] * n
            value = list(struct.unpack_from(f"<{n}{_FORMATS[sub]}", data, at + 5))
            kind, at = "B" + sub, at + 5 + size
        else:
            value = chr(data[at]) if kind == "A" else struct.unpack_from("<" + _FORMATS[kind], data, at)[0]
            at += _SIZES[kind]
        yield tag, kind, value, data[begin:at]


def tag_texts(tags: bytes | None) -> list[str]:
    """Tags as the text format writes them."""
    out = []
    for tag, kind, value, _ in _tags(tags or b""):
        if kind[0] == "B":
            out.append(f"{tag}:B:{kind[1]},{','.join(f'{x:.9g}' if kind[1] == 'f' else str(x) for x in value)}")
        else:
            shown = "i" if kind in "cCsSiI" else kind
            out.append(f"{tag}:{shown}:{f'{value:.9g}' if kind == 'f' else value}")
    return out


def parse_record(data: bytes, names: list[str], full: bool = False) -> tuple:
    """A row of SCHEMA, or of FULL. The sequence is in its original orientation; missing values are null."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", data, 0)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
    at += (n_seq + 1) // 2
    phred = data[at : at + n_seq]
    at += n_seq
    listed = list(_tags(data[at:]))
    tags = {t: (k, v) for t, k, v, _ in listed}
    reverse = bool(flag & 16)
    if reverse:
        seq = seq.translate(_COMPLEMENT)[::-1]
    mm, ml = tags.get("MM", tags.get("Mm")), tags.get("ML", tags.get("Ml"))
    row = (
        name, flag, names[ref] if ref >= 0 else None, pos if pos >= 0 else None, 0 if mapq == 255 else mapq,
        "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or None, "-" if reverse else "+", seq or None,
        mm[1] if mm and mm[0] == "Z" else None, ml[1] if ml and ml[0] == "BC" else None,
    )
    if not full:
        return row
    qual = None if not phred or phred[0] == 255 else bytes(q + 33 for q in (phred[::-1] if reverse else phred)).decode()
    rest = b"".join(x for t, k, _, x in listed if not (t in ("MM", "Mm") and k == "Z" or t in ("ML", "Ml") and k == "BC"))
    return (*row, qual, names[mate] if mate >= 0 else None, mate_pos if mate_pos >= 0 else None, length, rest)


def encode_record(row: dict, index: dict[str, int]) -> bytes:
    """A row of SCHEMA or FULL as a record with its size; sequence and qualities go back to the alignment's orientation."""
    seq, qual = row["seq"] or "", row.get("qual")
    if row["flag"] & 16:
        seq, qual = seq.translate(_COMPLEMENT)[::-1], qual and qual[::-1]
    ops = re.findall(rf"(\d+)([{_OPS}])", row["cigar"] or "")
    span = sum(int(n) for n, o in ops if o in "MDN=X") or 1
    place = lambda x: -1 if x is None else x
    named = lambda x: -1 if x is None else index[x]
    pos = place(row["start"])
    codes = [_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    tags = bytes(row.get("tags") or b"")
    if row["mm"] is not None:
        tags += b"MMZ" + row["mm"].encode() + b"\0"
    if row["ml"] is not None:
        tags += b"MLBC" + struct.pack("<i", len(row["ml"])) + bytes(row["ml"])
    name = row["read_id"].encode() + b"\0"
    where = region_bin(pos, pos + span) if pos >= 0 else 4680
    ends = named(row.get("mate_contig")), place(row.get("mate_start")), row.get("template_length") or 0
    body = struct.pack("<iiBBHHHiiii", named(row["contig"]), pos, len(name), row["mapq"] or 0, where, len(ops), row["flag"], len(seq), *ends) + name
    body += b"".join(struct.pack("<I", int(n) << 4 | _OPS.index(o)) for n, o in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(c - 33 for c in qual.encode()) if qual else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def encode_header(header: str, references: list[tuple[str, int]]) -> bytes:
    text = header.encode()
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for n, size in references:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return data


def blocks_of(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Compressed blocks of the bytes that ``parts`` make up."""
    data = bytearray()
    for part in parts:
        data += part
        while len(data) >= MOST_BYTES:
            yield compress_block(bytes(data[:MOST_BYTES]))
            del data[:MOST_BYTES]
    if data:
        yield compress_block(bytes(data))


def _known(reads: DataFrame) -> DataFrame:
    return reads.select(*(c for c in (x.split()[0] for x in FULL.split(", ")) if c in reads.columns))


def write_bam_folder(reads: DataFrame, folder: str, header: str, references: list[tuple[str, int]]) -> None:
    """A folder of BAM files, one per partition, each with the header; nothing passes the driver. The BAM source reads the folder.

    ``reads``: the columns of SCHEMA and, for whole records, those of FULL. A
    task that runs again replaces its file.
    """
    index = {n: i for i, (n, _) in enumerate(references)}
    head = encode_header(header, references)
    files.make_folder(folder)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder.rstrip('/')}/part-{task.partitionId():05d}.bam"
        with files.open_write(f"{path}.{task.taskAttemptId()}") as f:
            rows = (encode_record(r, index) for b in batches for r in b.to_pylist())
            for block in blocks_of(x for part in ((head,), rows) for x in part):
                f.write(block)
            f.write(END_BLOCK)
        files.move(f"{path}.{task.taskAttemptId()}", path)
        return iter(())

    _known(reads).mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def write_bam(reads: DataFrame, path: str, header: str, references: list[tuple[str, int]]) -> None:
    """One new BAM file, in the frame's order; rows pass the driver one partition at a time, as it is one file.

    ``reads`` as for ``write_bam_folder``, which is the way for large sets.
    """
    if not path.endswith(".bam"):
        raise BamError("the path must end in .bam")
    if files.exists(path):
        raise FileExistsError(path)
    index = {n: i for i, (n, _) in enumerate(references)}
    records = (encode_record(r.asDict(), index) for r in _known(reads).toLocalIterator())
    with files.open_write(path) as f:
        for block in blocks_of(x for part in ((encode_header(header, references),), records) for x in part):
            f.write(block)
        f.write(END_BLOCK)


def read_records(path: str, begin: int | None = None, end: int | None = None, full: bool = False) -> Iterator[tuple]:
    with files.open_read(path) as f:
        r = BgzfReader(f)
        names = [n for n, _ in read_header(r)[1]]
        if begin is not None:
            r = BgzfReader(f, begin)
        while end is None or r.tell() < end:
            size = r.read(4)
            if not size:
                return
            data = r.read(struct.unpack("<i", size)[0])
            if len(data) < 32:
                raise BamError("truncated record")
            yield parse_record(data, names, full)


def reference_offsets(bai: str) -> list[tuple[int, int] | None]:
    """Per reference of a .bai index its first and last virtual offset."""
    with files.open_read(bai) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise BamError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        (n_bins,) = struct.unpack_from("<i", data, at)
        at += 4
        spans = []
        for _ in range(n_bins):
            b, n = struct.unpack_from("<Ii", data, at)
            if b != 37450:
                spans += [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(n)]
            at += 8 + 16 * n
        (n_linear,) = struct.unpack_from("<i", data, at)
        at += 4 + 8 * n_linear
        out.append((min(s[0] for s in spans), max(s[1] for s in spans)) if spans else None)
    return out


@dataclass
class _Part(InputPartition):
    path: str
    begin: int | None = None
    end: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, full: bool = False) -> None:
        self.path, self.full = path, full

    def partitions(self) -> list[InputPartition]:
        names = files.found(self.path, "*.bam")
        if not names:
            raise FileNotFoundError(self.path)
        out: list[InputPartition] = []
        for f in names:
            bai = next((b for b in (f + ".bai", f[:-4] + ".bai") if files.exists(b)), None)
            spans = [s for s in reference_offsets(bai) if s] if bai else []
            if spans:
                out += [_Part(f, a, b) for a, b in spans] + [_Part(f, max(b for _, b in spans))]
            else:
                out.append(_Part(f))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        return read_records(partition.path, partition.begin, partition.end, self.full)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandlake_bam"

    def _full(self) -> bool:
        return self.options.get("full", "false").lower() == "true"

    def schema(self) -> str:
        return FULL if self._full() else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._full())
