"""Cutting long sequences into overlapping pieces at natural boundaries.

Method: a sequence is a row of tokens, runs of known bases and gaps of unknown
ones, whose offsets are prefix sums of their lengths. The ends of the runs
before gaps are the sorted boundary array. From a piece's start, binary search
finds the last boundary within the limit; the piece ends there and the next one
begins after the gap. Without such a boundary the piece is cut at the limit and
the next one steps back by the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, GAP = 10_000, 200, 20
#: Letters of unknown bases.
UNKNOWN = "Nn-"
_BATCH_BYTES = 4 << 20


def _codes(text: str) -> np.ndarray:
    """Code points of the text without white space."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), dtype=np.uint8)
        return codes[~_ASCII_SPACE[codes]]
    codes = np.frombuffer("".join(text.split()).encode("utf-32-le"), dtype=np.uint32)
    return codes


_ASCII_SPACE = np.array([chr(i).isspace() for i in range(256)])


def _decode(codes: np.ndarray) -> str:
    return codes.tobytes().decode("ascii" if codes.dtype == np.uint8 else "utf-32-le")


def stretches(codes: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bases outside gaps of at least ``gap`` unknown bases."""
    unknown = np.isin(codes, np.array([ord(c) for c in UNKNOWN], dtype=codes.dtype))
    edges = np.flatnonzero(unknown[1:] != unknown[:-1]) + 1
    lengths = np.diff(np.concatenate(([0], edges, [len(codes)])))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    is_gap = (np.arange(len(lengths)) % 2 == (0 if unknown[0] else 1)) & (lengths >= gap)
    starts = np.concatenate(([0], offsets[1:][is_gap]))
    ends = np.concatenate((offsets[:-1][is_gap], [len(codes)]))
    return starts[starts < ends], ends[starts < ends]


def pieces(starts: np.ndarray, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces as (start, end, first stretch that begins in it, last such stretch + 1)."""
    out, i, at, fresh = [], 0, int(starts[0]) if len(starts) else 0, True
    while i < len(starts):
        last = int(np.searchsorted(ends, at + limit, side="right")) - 1
        if last >= i:
            out.append((at, int(ends[last]), i if fresh else i + 1, last + 1))
            i = last + 1
            at, fresh = int(starts[i]) if i < len(starts) else at, True
        else:
            out.append((at, at + limit, i if fresh else i + 1, i + 1))
            at, fresh = at + limit - overlap, False
    return out


def split_long(rows: DataFrame, key: str, sequence: str, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP, with_text: bool = True) -> DataFrame:
    """Pieces of every sequence of more than ``limit`` bases; shorter ones aren't cut and give no row.

    Columns: ``key`` (as given), ``piece_no`` from 0, ``piece_start`` and
    ``piece_end`` (offsets in the bases, which are all characters but white
    space), ``stretch_starts`` (offsets of the stretches that begin in the
    piece) and, unless ``with_text`` is false, ``bases``. A piece has at most
    ``limit`` bases. Between pieces either a gap lies or they share
    ``overlap`` bases; gaps at cuts are in no piece, gaps within a piece stay.
    Null and empty sequences give no row; neither do sequences of gaps alone,
    which have nothing to cut out. Repeated rows are cut each time, null keys
    are kept, and only ``key`` and ``sequence`` are read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if limit < 1 or gap < 1:
        raise ValueError("limit and gap must be positive")
    picked = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{sequence}`").alias("_seq")).where(F.length("_seq") > limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for r in range(batch.num_rows):
                codes = _codes(batch.column(1)[r].as_py())
                if len(codes) <= limit:
                    continue
                starts, ends = stretches(codes, gap)
                for no, (a, b, i, j) in enumerate(pieces(starts, ends, limit, overlap)):
                    out.append((r, no, a, b, starts[i:j].tolist(), _decode(codes[a:b]) if with_text else None))
                    size += b - a if with_text else 64
                    if size > _BATCH_BYTES:
                        yield batch_of(batch, out)
                        out, size = [], 0
            if out:
                yield batch_of(batch, out)

    def batch_of(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        r, no, a, b, s, t = zip(*out)
        cols = {"_key": batch.column(0).take(pa.array(r)), "piece_no": pa.array(no, pa.int32()), "piece_start": pa.array(a, pa.int64()), "piece_end": pa.array(b, pa.int64()), "stretch_starts": pa.array(s, pa.list_(pa.int64()))}
        if with_text:
            cols["bases"] = pa.array(t, pa.string())
        return pa.RecordBatch.from_pydict(cols)

    schema = f"_key {picked.schema['_key'].dataType.simpleString()}, piece_no int, piece_start long, piece_end long, stretch_starts array<long>" + ", bases string" * with_text
    return picked.mapInArrow(cut, schema).withColumnRenamed("_key", key)
