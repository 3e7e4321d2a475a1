"""Motifs on reads: calls from MM/ML tags, CIGAR projection and mapping status.

What concerns one read stays in one row: tags, alignment and motif hits are
computed per read on arrays, in Arrow batches, without a shuffle. Only the
question whether the reference has the motif too is a join.

``mode``: ``spec`` aligns qualities with their skips as the SAM specification
says; ``compat`` doesn't advance over the qualities of segments it doesn't
know, cuts the last character of every descriptor, and lets a repeated type
replace the earlier one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.modtags import DESCRIPTOR
from strandlake.functions.motif import Motif
from strandlake.operators.scan import Letters, block_of, motif_blocks, offset_of, with_motifs

_KNOWN = {("A", "a"): "a", ("C", "m"): "m", ("C", "21839"): "21839"}
_BASE = {"a": "A", "m": "C", "21839": "C"}
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_NOWHERE = -1
#: Calls or hits that a task holds before it hands them on; a read's own are never cut.
MOST_ROWS = 100_000


class ReadError(ValueError):
    """Tags or an alignment that can't be read."""


def _segments(mm: str, ml: np.ndarray, mode: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(type, skips, qualities) of the known segments."""
    parts = [s for s in mm.split(";") if s]
    total = sum(s.count(",") for s in parts)
    if total != len(ml):
        raise ReadError(f"MM/ML length mismatch: {total} modifications but {len(ml)} quality scores")
    at, last = 0, {}
    for s in parts:
        head, _, tail = s.partition(",")
        if not tail:
            continue
        if mode == "compat":
            if len(head) < 3:
                raise ReadError(f"descriptor too short: '{head}'")
            kind, code_known = None, _KNOWN.get((head[0], head[2:-1]))
            if code_known:
                skips = [int(x) for x in tail.split(",") if x.isdigit()]
                n = min(len(skips), len(ml) - at)
                last[code_known] = (np.array(skips[:n], dtype=np.int64), ml[at : at + n].astype(np.int64))
                at += len(skips)
            continue
        n = tail.count(",") + 1
        m = re.match(DESCRIPTOR, head)
        kind = _KNOWN.get((m.group(1), m.group(3))) if m else None
        if kind and all(x.isdigit() for x in tail.split(",")):
            yield kind, np.array(tail.split(","), dtype=np.int64), ml[at : at + n].astype(np.int64)
        at += n
    for kind, (skips, q) in last.items():
        yield kind, skips, q


def decode_calls(seq: str, mm: str | None, ml: list[int] | np.ndarray | None, mode: str = "spec") -> tuple[np.ndarray, list[str], np.ndarray]:
    """Positions, types and qualities of a read's calls.

    At each position the call of the highest quality counts; a tie at the top
    leaves none. Skips beyond the last base of their kind are ignored.
    """
    if not mm:
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64)
    letters = np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)
    pos, kinds, quals = [], [], []
    for kind, skips, q in _segments(mm, np.zeros(0, dtype=np.int64) if ml is None else np.asarray(ml, dtype=np.int64), mode):
        index = np.cumsum(skips) + np.arange(len(skips))
        target = np.flatnonzero(letters == ord(_BASE[kind]))
        ok = index < len(target)
        pos.append(target[index[ok]])
        quals.append(q[ok])
        kinds += [kind] * int(ok.sum())
    if not pos:
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64)
    p, q = np.concatenate(pos), np.concatenate(quals)
    order = np.lexsort((-q, p))
    first = np.ones(len(p), dtype=bool)
    first[1:] = p[order][1:] != p[order][:-1]
    tied = np.zeros(len(p), dtype=bool)
    tied[:-1] = (p[order][1:] == p[order][:-1]) & (q[order][1:] == q[order][:-1])
    take = order[first & ~tied]
    return p[take], [kinds[i] for i in take], q[take]


def position_map(cigar: str, start: int, length: int) -> np.ndarray:
    """Reference position of each read base, -1 where it isn't aligned.

    M, = and X align; I and S take read bases only; D and N reference bases
    only; H and P neither.
    """
    out = np.full(length, _NOWHERE, dtype=np.int64)
    read, ref = 0, start
    for n, op in ((int(a), b) for a, b in _CIGAR.findall(cigar or "")):
        if op in "M=X":
            end = min(read + n, length)
            if read < end:
                out[read:end] = np.arange(ref, ref + end - read)
            read, ref = read + n, ref + n
        elif op in "IS":
            read += n
        elif op in "DN":
            ref += n
    return out


def reference_position(cigar: str, start: int, read_pos: int) -> int | None:
    """Reference position of one read base."""
    p = position_map(cigar, start, read_pos + 1)[read_pos]
    return None if p == _NOWHERE else int(p)


def mapping_status(aligned: np.ndarray, starts: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Status of windows of ``width`` bases from ``starts`` whose modified base is at reference position ``at``."""
    window = starts[:, None] + np.arange(width)
    inside = (window >= 0) & (window < len(aligned))
    ref = np.where(inside, aligned[np.clip(window, 0, len(aligned) - 1)], _NOWHERE)
    whole = (ref != _NOWHERE).all(axis=1)
    steps = (np.diff(ref, axis=1) == 1).all(axis=1) if width > 1 else np.ones(len(starts), dtype=bool)
    return np.where(at == _NOWHERE, "unmapped", np.where(~whole, "partial", np.where(steps, "complete", "gapped")))


def _values(column: pa.ListArray, i: int) -> np.ndarray | None:
    """One row's list of whole numbers, without a copy; null qualities aren't allowed."""
    return column[i].values.to_numpy() if column[i].is_valid else None


def _rows(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """Some columns row by row; only one row's values are made at a time."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in columns)


def read_calls(reads: DataFrame, mode: str = "spec") -> DataFrame:
    """``read_id, position, mod_type, quality`` of all calls. ``reads``: ``read_id, seq, mm, ml``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, pos, qual = [], [], [], []
            for i, (read_id, seq, mm) in enumerate(_rows(b, 0, 1, 2)):
                p, k, q = decode_calls(seq or "", mm, _values(b.column(3), i), mode)
                ids += [read_id] * len(p)
                kinds += k
                pos.append(p)
                qual.append(q)
                if ids and (len(ids) >= MOST_ROWS or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate(pos), pa.int32()), pa.array(kinds, pa.string()), pa.array(np.concatenate(qual), pa.int32())], names=["read_id", "position", "mod_type", "quality"])
                    ids, kinds, pos, qual = [], [], [], []

    return reads.select("read_id", "seq", "mm", F.col("ml").cast("array<int>")).mapInArrow(run, "read_id string, position int, mod_type string, quality int")


_HITS = "read_id string, contig string, strand string, mapq int, read_length int, motif_id int, start_read int, start_contig int, quality int, status string"


def read_hits(reads: DataFrame, motifs: list[Motif], aligned: bool, mode: str = "spec") -> DataFrame:
    """Forward motif hits on reads with the quality called there (0 without a call).

    The quality is that of the position, whatever its type. ``reads``:
    ``read_id, seq, mm, ml`` and, if ``aligned``, ``contig, start, strand,
    cigar, mapq``; ``seq`` is in its original orientation, so a reverse read's
    alignment runs against it. The status of a reverse read's motif looks at
    the window that begins ``mod_position`` before the flipped position.
    """
    extra = ["contig", "start", "strand", "cigar", "mapq"]
    picked = reads.select("read_id", "seq", "mm", F.col("ml").cast("array<int>"), *([F.col(c) for c in extra] if aligned else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            sizes: list[int] = []
            arrays: list[tuple] = []
            for r, (read_id, seq, mm, *where) in enumerate(_rows(b, 0, 1, 2, *((4, 5, 6, 7, 8) if aligned else ()))):
                if seq:
                    for head, found in hits(read_id, seq, mm, _values(b.column(3), r), where):
                        out.append(head)
                        sizes.append(len(found[0]))
                        arrays.append(found)
                if out and (sum(sizes) >= MOST_ROWS or r == b.num_rows - 1):
                    yield packed(out, sizes, arrays)
                    out, sizes, arrays = [], [], []

    def hits(read_id: str, seq: str, mm: str | None, ml: np.ndarray | None, where: list) -> Iterator[tuple[tuple, tuple]]:
        """What all hits of a read and a motif have in common, and their position, reference position, quality and status."""
        n = len(seq)
        letters = Letters(seq)
        quality = np.zeros(n, dtype=np.int64)
        p, _, q = decode_calls(seq, mm, ml, mode)
        quality[p] = q
        contig, start, strand, cigar, mapq = where if aligned else (None, 0, None, None, None)
        ref = position_map(cigar, start, n) if aligned else None
        for i, m in enumerate(motifs):
            starts = letters.starts_of(m.sequence)
            if not len(starts):
                continue
            at = starts + m.mod_position
            if aligned:
                original = n - at - 1 if strand == "-" else at
                genome = ref[original]
                status = mapping_status(ref, original - m.mod_position, genome, len(m.sequence))
            else:
                genome, status = np.zeros(len(at), dtype=np.int64), np.full(len(at), "")
            yield (read_id, contig, strand, mapq, n, i), (at, genome, quality[at], status)

    def packed(out: list[tuple], sizes: list[int], arrays: list[tuple]) -> pa.RecordBatch:
        index = pa.array(np.repeat(np.arange(len(out)), sizes))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        heads = [pa.array([o[j] for o in out], kinds[j]).take(index) for j in range(6)]
        tails = [pa.array(np.concatenate([a[j] for a in arrays]), pa.int32()) for j in range(3)]
        tails.append(pa.array(np.concatenate([a[3].astype(object) for a in arrays]), pa.string()))
        return pa.RecordBatch.from_arrays([*heads, *tails], names=[x.split()[0] for x in _HITS.split(", ")])

    return picked.mapInArrow(run, _HITS)


def read_fastq_pattern(reads: DataFrame, motifs: list[Motif], mode: str = "spec") -> DataFrame:
    """``read_id, start, read_length, motif_seq, mod_type, mod_pos, quality`` of every hit on raw reads."""
    hits = with_motifs(read_hits(reads, motifs, aligned=False, mode=mode), motifs)
    return hits.select("read_id", F.col("start_read").alias("start"), "read_length", F.col("motif").alias("motif_seq"), "mod_type", F.col("mod_position").alias("mod_pos"), "quality")


def read_bam_pattern(reads: DataFrame, contigs: DataFrame, motifs: list[Motif], mode: str = "spec") -> DataFrame:
    """Every hit on mapped reads, with the alignment's view of it (13 columns).

    Only reads whose contig is in the assembly are used. The positions of the
    reference's own motifs join by blocks of positions.
    """
    mapped = reads.join(contigs.select("contig").distinct(), "contig", "left_semi")
    hits = read_hits(mapped, motifs, aligned=True, mode=mode)
    # tiles meet within a block now and then: then its lists are put together
    own = motif_blocks(contigs, motifs).groupBy("contig", "motif_id", "strand", "block").agg(F.flatten(F.collect_list("offsets")).alias("offsets"))
    placed = hits.withColumn("block", F.when(F.col("start_contig") >= 0, block_of(F.col("start_contig"))).otherwise(-1 - F.pmod(F.hash("read_id"), F.lit(4096))))
    joined = placed.join(own, ["contig", "motif_id", "strand", "block"], "left")
    flagged = with_motifs(joined.withColumn("_has", F.array_contains("offsets", offset_of(F.col("start_contig")))), motifs)
    return flagged.select(
        F.col("contig").alias("contig_id"), "start_contig", F.coalesce("_has", F.lit(False)).alias("reference_has_motif"), "strand", "read_id", "read_length",
        F.coalesce("mapq", F.lit(0)).alias("mapping_quality"), "start_read", "motif", "mod_type", F.col("mod_position").cast("string").alias("mod_position"),
        F.col("quality").alias("basecall_quality"), F.col("status").alias("mapping_status"),
    )


def filter_reads(reads: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Reads whose id is listed; the list may be a frame with ``read_id``."""
    if isinstance(ids, list):
        ids = reads.sparkSession.createDataFrame([(i,) for i in ids], "read_id string")
    return reads.join(ids.select("read_id").distinct(), "read_id", "left_semi")


def primary(reads: DataFrame) -> DataFrame:
    """Without secondary alignments; supplementary ones stay."""
    return reads.where(F.col("flag").bitwiseAND(256) == 0)
