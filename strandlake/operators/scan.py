"""Finding motifs in sequences.

A scan matches wherever the letters of motif and sequence share a base, so N in
a contig matches any base, and matches may overlap. Sequences are compared as
arrays of bit masks, one vector operation per motif letter; long sequences are
cut into overlapping tiles first, which bounds what a task holds. A scan runs
where its sequences lie: no exchange, as assemblies are spread when they are made.
Hits leave the scan as lists per block of positions, so that joins move one row
per block and not one per hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.iupac import MASK_OF_BYTE, MASKS
from strandlake.functions.motif import Motif, patterns

TILE = 2_000_000
#: Hits are listed per 2 ** BLOCK_BITS positions.
BLOCK_BITS = 12


def mask_array(sequence: str) -> np.ndarray:
    return MASK_OF_BYTE[np.frombuffer(sequence.encode("ascii", "replace"), dtype=np.uint8)]


class Letters:
    """A sequence's masks, and for each motif letter where the sequence can match it, made once and used by all patterns."""

    def __init__(self, sequence: str) -> None:
        self.masks = mask_array(sequence)
        self._where: dict[str, np.ndarray | None] = {}

    def where(self, letter: str) -> np.ndarray | None:
        """None if the letter matches everywhere."""
        if letter not in self._where:
            hit = (self.masks & MASKS[letter]) != 0
            self._where[letter] = None if hit.all() else hit
        return self._where[letter]

    def starts_of(self, letters: str) -> np.ndarray:
        """Start of every match."""
        n = len(self.masks) - len(letters) + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        hit = None
        for i, x in enumerate(letters):
            w = self.where(x)
            if w is not None:
                hit = w[i : i + n].copy() if hit is None else np.logical_and(hit, w[i : i + n], out=hit)
        return np.arange(n) if hit is None else np.flatnonzero(hit)


def find_motif(sequence: str, motif: Motif) -> list[int]:
    """Positions of the modified base of all matches in one sequence."""
    return (Letters(sequence).starts_of(motif.sequence) + motif.mod_position).tolist()


def motif_table(motifs: list[Motif]) -> list[tuple[int, str, str, int]]:
    return [(i, m.sequence, m.mod_type, m.mod_position) for i, m in enumerate(motifs)]


def motif_blocks(contigs: DataFrame, motifs: list[Motif], strands: str = "+-", tile: int = TILE) -> DataFrame:
    """All hits by block: ``contig, motif_id, strand, block, offsets``.

    ``contigs``: ``contig``, ``sequence`` in upper case. ``motif_id`` is the
    index in ``motifs``; a hit's position is ``block << BLOCK_BITS`` plus its
    offset. Null and empty sequences have no hits. A block may come in two rows
    where tiles meet, each hit in one of them. The sequences aren't moved, so
    ``contigs`` should lie in as many partitions as there are cores.
    """
    pats = patterns(dict.fromkeys(motifs), strands)
    ids = {m: i for i, m in reversed(list(enumerate(motifs)))}
    longest = max((len(p.letters) for p in pats), default=1)
    step = max(tile, longest)
    whole = contigs.select("contig", "sequence").where(F.length("sequence") > 0)
    cut = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.length("sequence") - 1, F.lit(step)).cast("int")),
        lambda i: F.struct((i.cast("long") * step).alias("at"), F.substring("sequence", i * step + 1, F.lit(step + longest - 1)).alias("piece")),
    )
    single = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("sequence").alias("piece")))
    tiles = whole.select("contig", F.inline(F.when(F.length("sequence") > step, cut).otherwise(single)))
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            for r in range(batch.num_rows):
                letters = Letters(batch.column(2)[r].as_py())
                heads, strand_of, blocks, values, starts, n = [], [], [], [], [], 0
                for p in pats:
                    s = letters.starts_of(p.letters)
                    pos = s[s < step] + (p.offset + at[r])
                    if not len(pos):
                        continue
                    block = pos >> BLOCK_BITS
                    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                    heads.append(np.full(len(first), ids[p.motif]))
                    strand_of += [p.strand] * len(first)
                    blocks.append(block[first])
                    starts.append(first + n)
                    values.append(pos & ((1 << BLOCK_BITS) - 1))
                    n += len(pos)
                if not n:
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.concatenate(starts), n), pa.int32()), pa.array(np.concatenate(values), pa.int32()))
                names = pa.array([batch.column(0)[r].as_py()]).take(pa.array(np.zeros(len(lists), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.concatenate(heads), pa.int32()), pa.array(strand_of), pa.array(np.concatenate(blocks), pa.int64()), lists],
                    names=["contig", "motif_id", "strand", "block", "offsets"],
                )

    return tiles.mapInArrow(scan, "contig string, motif_id int, strand string, block long, offsets array<int>")


def motif_positions(contigs: DataFrame, motifs: list[Motif], strands: str = "+-", tile: int = TILE) -> DataFrame:
    """All hits, one per row: ``contig, motif_id, strand, position``."""
    rows = motif_blocks(contigs, motifs, strands, tile).select("contig", "motif_id", "strand", "block", F.explode("offsets").alias("_offset"))
    return rows.select("contig", "motif_id", "strand", (F.shiftleft("block", BLOCK_BITS) + F.col("_offset")).alias("position"))


def block_of(position: Column) -> Column:
    return F.shiftright(position.cast("long"), BLOCK_BITS)


def offset_of(position: Column) -> Column:
    return position.cast("long").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def with_motifs(rows: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Replace ``motif_id`` by ``motif, mod_type, mod_position``."""
    table = rows.sparkSession.createDataFrame(motif_table(motifs), "motif_id int, motif string, mod_type string, mod_position int")
    return rows.join(F.broadcast(table), "motif_id").drop("motif_id")


def occurrences(blocks: DataFrame, by_strand: bool = True) -> DataFrame:
    """Number of hits per contig, motif (and strand)."""
    keys = ["contig", "motif_id"] + ["strand"] * by_strand
    return blocks.groupBy(*keys).agg(F.sum(F.size("offsets")).alias("n_occurrences"))
