"""The IUPAC nucleotide alphabet: masks, complements, match classes and sort keys."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in sort order and the bases that each stands for, in expansion order.
LETTERS = "ACGTRYSWKMBDHVN"
EXPANSIONS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATGC",
}
#: Bit of each base, and modification codes with their base, name and sort rank.
BITS = {"A": 1, "T": 2, "G": 4, "C": 8}
MOD_TYPES = {"a": ("A", "6mA", 0), "m": ("C", "5mC", 1), "21839": ("C", "4mC", 2)}

MASKS = {letter: sum(BITS[b] for b in bases) for letter, bases in EXPANSIONS.items()}
_BY_MASK = {m: letter for letter, m in MASKS.items()}
COMPLEMENTS = {letter: _BY_MASK[sum({1: 2, 2: 1, 4: 8, 8: 4}[b] for b in (1, 2, 4, 8) if MASKS[letter] & b)] for letter in LETTERS}

_FROM, _TO = LETTERS, "".join(COMPLEMENTS[x] for x in LETTERS)
#: Mask of every byte; 0 for what is no letter.
MASK_OF_BYTE = np.array([MASKS.get(chr(i), 0) for i in range(256)], dtype=np.uint8)


class IupacError(ValueError):
    """A letter or set of bases outside the alphabet."""


def check_letters(sequence: str) -> str:
    """The sequence, if it has only the 15 upper-case letters."""
    for x in sequence:
        if x not in MASKS:
            raise IupacError(f"Base '{x}' in sequence '{sequence}' is not a valid IUPAC code")
    return sequence


def overlap_class(letter: str) -> str:
    """Regex of all letters that share a base with this one; a scan matches where bases can be equal."""
    hits = "".join(x for x in LETTERS if MASKS[x] & MASKS[letter])
    return f"[{hits}]" if len(hits) > 1 else hits


def display_regex(letter: str) -> str:
    """Regex of the plain bases of a letter, '.' for N."""
    bases = "".join(sorted(EXPANSIONS[letter]))
    return "." if letter == "N" else bases if len(bases) == 1 else f"[{bases}]"


def from_bases(bases: str | list[str]) -> str:
    """The letter for a set of bases, in any order and case."""
    found = {b.upper() for b in bases}
    if not found or not found <= set(BITS):
        raise IupacError(f"no IUPAC letter stands for {sorted(found)}")
    return _BY_MASK[sum(BITS[b] for b in found)]


def complement_text(sequence: str) -> str:
    return "".join(COMPLEMENTS[x] for x in check_letters(sequence)[::-1])


# -- column expressions


def reverse_complement(sequence: Column) -> Column:
    """Reverse complement of an upper-case sequence; null stays null."""
    return F.reverse(F.translate(sequence, _FROM, _TO))


def mask(letter: Column) -> Column:
    """Bit mask of a letter; null for what is no letter."""
    return _lookup(MASKS, letter)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def letter_of_mask(m: Column) -> Column:
    return _lookup(_BY_MASK, m)


def bases_of(letter: Column) -> Column:
    """Array of the bases that a letter stands for."""
    return F.split(_lookup(EXPANSIONS, letter), "")


def letters_of(sequence: Column) -> Column:
    """Array of a sequence's letters."""
    return F.split(sequence, "")


def regex_of(sequence: Column) -> Column:
    """The display regex of a sequence."""
    table = {x: display_regex(x) for x in LETTERS}
    return F.array_join(F.transform(letters_of(sequence), lambda x: _lookup(table, x)), "")


def is_iupac(sequence: Column) -> Column:
    return sequence.rlike(rf"\A[{LETTERS}]*\z")


def is_plain(sequence: Column) -> Column:
    """Only A, C, G, T and N, in either case."""
    return sequence.rlike(r"\A[ACGTNacgtn]*\z")


def sequence_key(sequence: Column) -> Column:
    """A string that sorts as sequences do: A C G T R Y S W K M B D H V N."""
    return F.translate(sequence, LETTERS, "ABCDEFGHIJKLMNO")


def mod_rank(mod_type: Column) -> Column:
    """Sort rank of a modification code; null for others."""
    return reduce(lambda acc, kv: acc.when(mod_type == kv[0], kv[1][2]), list(MOD_TYPES.items())[1:], F.when(mod_type == "a", 0))


def strand_rank(strand: Column) -> Column:
    return F.when(strand == "+", 0).when(strand == "-", 1)


def base_of_mod(mod_type: Column) -> Column:
    return F.when(mod_type == "a", "A").when(mod_type.isin("m", "21839"), "C")


def mod_name(mod_type: Column) -> Column:
    return _lookup({k: f"{v[1]} ({k})" for k, v in MOD_TYPES.items()}, mod_type)


def mod_of_sam_code(base: Column, code: Column) -> Column:
    """Pileup code of a base and its code in a modification tag; null for what isn't supported."""
    return F.when((base == "A") & (code == "a"), "a").when((base == "C") & code.isin("m", "21839"), code)
