"""Motifs: validation, parsing, parent and child, and the pattern table of a scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from strandlake.functions import iupac


class MotifError(ValueError):
    """A motif that isn't valid."""


@dataclass(frozen=True, order=False)
class Motif:
    """A sequence of IUPAC letters with one modified base."""

    sequence: str
    mod_type: str
    mod_position: int

    @classmethod
    def new(cls, sequence: str, mod_type: str, mod_position: int) -> Motif:
        """Checked in this order: type, letters, bounds, base, ends."""
        if mod_type not in iupac.MOD_TYPES:
            raise MotifError(f"Unsupported mod type: {mod_type}")
        try:
            iupac.check_letters(sequence)
        except iupac.IupacError as e:
            raise MotifError(str(e)) from None
        if not 0 <= mod_position < len(sequence):
            raise MotifError(f"mod_position {mod_position} is out of bounds for sequence of length {len(sequence)}. Note mod_position is 0-indexed.")
        base, name, _ = iupac.MOD_TYPES[mod_type]
        if sequence[mod_position] != base:
            what = "6mA." if mod_type == "a" else f"{name} ({mod_type}) modification type."
            raise MotifError(f"mod_position {mod_position} points to base '{sequence[mod_position]}' which is invalid for {what}")
        if "N" in (sequence[0], sequence[-1]):
            raise MotifError(f"Motif sequence starts or ends with N, which is invalid: {sequence}")
        return cls(sequence, mod_type, mod_position)

    @classmethod
    def parse(cls, text: str) -> Motif:
        """From ``SEQUENCE_type_position``."""
        parts = text.split("_")
        if len(parts) != 3:
            raise MotifError(f"Invalid motif format '{text}' encountered. Expected format: '<sequence>_<mod_type>_<mod_position>'")
        if not parts[2].isascii() or not parts[2].isdigit() or int(parts[2]) > 255:
            raise MotifError(f"Failed to parse mod_position '{parts[2]}' in motif '{text}'.")
        return cls.new(parts[0], parts[1], int(parts[2]))

    def __str__(self) -> str:
        return f"{self.sequence}_{self.mod_type}_{self.mod_position}"

    def reverse_complement(self) -> Motif:
        return Motif(iupac.complement_text(self.sequence), self.mod_type, len(self.sequence) - self.mod_position - 1)

    def to_regex(self) -> str:
        return "".join(map(iupac.display_regex, self.sequence))

    def expansions(self) -> list[str]:
        """All plain sequences that the motif stands for."""
        return ["".join(x) for x in product(*(iupac.EXPANSIONS[c] for c in self.sequence))]

    def n_expansions(self) -> int:
        n = 1
        for c in self.sequence:
            n *= len(iupac.EXPANSIONS[c])
        return n

    def extend_with_n(self, n: int) -> Motif:
        return Motif(self.sequence + "N" * n, self.mod_type, self.mod_position)

    def prepend_n(self, n: int) -> Motif:
        return Motif("N" * n + self.sequence, self.mod_type, self.mod_position + n)

    def has_child(self, child: Motif) -> bool:
        """Whether the child holds this motif, with the modified bases aligned and every pair of letters sharing a base."""
        at = child.mod_position - self.mod_position
        if self.mod_type != child.mod_type or at < 0 or at + len(self.sequence) > len(child.sequence):
            return False
        return all(iupac.MASKS[p] & iupac.MASKS[c] for p, c in zip(self.sequence, child.sequence[at:]))

    def sort_key(self) -> tuple:
        return [iupac.LETTERS.index(c) for c in self.sequence], iupac.MOD_TYPES[self.mod_type][2], self.mod_position


def parse_motifs(texts: Iterable[str]) -> list[Motif]:
    return [Motif.parse(t) for t in texts]


def collapse_children(motifs: list[Motif]) -> list[Motif]:
    """Drop, of each parent and child, the longer one; of equal lengths the one with fewer expansions, else the first.

    Dropping is by value: equal motifs are each other's children, so all copies go.
    """
    victims = set()
    for i, a in enumerate(motifs):
        for b in motifs[i + 1 :]:
            if a.has_child(b) or b.has_child(a):
                by_length = len(a.sequence) - len(b.sequence)
                victims.add(a if by_length > 0 or by_length == 0 and a.n_expansions() <= b.n_expansions() else b)
    return [m for m in motifs if m not in victims]


def union_motif(motifs: list[Motif]) -> Motif:
    """The motif whose letters stand for all bases that the motifs have at each position."""
    if not motifs or len({len(m.sequence) for m in motifs}) != 1:
        raise MotifError("motifs must have one length")
    if len({(m.mod_type, m.mod_position) for m in motifs}) != 1:
        raise MotifError("motifs must have one modification")
    letters = (iupac.from_bases({b for c in column for b in iupac.EXPANSIONS[c]}) for column in zip(*(m.sequence for m in motifs)))
    return Motif.new("".join(letters), motifs[0].mod_type, motifs[0].mod_position)


@dataclass(frozen=True)
class Pattern:
    """What a scan looks for on one strand: the letters in forward orientation and the modified base's offset."""

    motif: Motif
    strand: str
    letters: str
    offset: int


def patterns(motifs: Iterable[Motif], strands: str = "+-") -> list[Pattern]:
    """Two patterns per motif; the reverse strand is scanned on the forward sequence with the reverse complement."""
    out = []
    for m in motifs:
        for s in strands:
            p = m if s == "+" else m.reverse_complement()
            out.append(Pattern(m, s, p.sequence, p.mod_position))
    return out
