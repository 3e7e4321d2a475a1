"""Base-modification tags: MM strings with their ML qualities.

An MM string is a list of segments ``descriptor,skip,skip,...;``; the ML array
has one quality per skip of all segments, in order. A descriptor is a base, a
strand, a code of lower-case letters or digits and maybe ``.`` or ``?``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

DESCRIPTOR = r"^([ACGT])([+-])([a-z]*|[0-9]*)([.?]?)$"


class TagError(ValueError):
    """A descriptor, rename or tag pair that isn't valid."""


@dataclass(frozen=True)
class Descriptor:
    base: str
    strand: str
    code: str
    flag: str = ""

    @classmethod
    def parse(cls, text: str) -> Descriptor:
        """An empty code needs a flag: ``C+.`` is one, ``C+`` isn't."""
        if not text.strip():
            raise TagError("Cannot parse empty tag key")
        m = re.match(DESCRIPTOR, text)
        if not m or len(text) < 3:
            raise TagError(f"invalid tag key: '{text}'")
        return cls(*m.groups())

    def with_code(self, code: str) -> Descriptor:
        return replace(self, code=code)

    def __str__(self) -> str:
        return f"{self.base}{self.strand}{self.code}{self.flag}"


def parse_rename(text: str) -> tuple[Descriptor, Descriptor]:
    """``C+21839.:m``: a descriptor and its new code."""
    old, sep, code = text.partition(":")
    if not sep or not re.fullmatch(r"[a-z]+|[0-9]+", code):
        raise TagError(f"invalid rename: '{text}'")
    d = Descriptor.parse(old)
    return d, d.with_code(code)


# -- column expressions over mm STRING and ml ARRAY<INT>


def segments(mm: Column) -> Column:
    """Array of the non-empty segments; null stays null."""
    return F.filter(F.split(mm, ";"), lambda s: s != "")


def descriptor_of(segment: Column) -> Column:
    return F.substring_index(segment, ",", 1)


def n_skips(segment: Column) -> Column:
    return F.size(F.split(segment, ",")) - 1


def segment_table(mm: Column) -> Column:
    """Array of (descriptor, skips, first): each segment with the index of its first quality."""
    start = F.struct(F.array().cast("array<struct<descriptor:string,skips:string,first:int>>").alias("out"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        row = F.struct(descriptor_of(s).alias("descriptor"), F.when(F.contains(s, F.lit(",")), F.substring(s, F.length(descriptor_of(s)) + 2, F.length(s))).otherwise("").alias("skips"), acc["n"].alias("first"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), (acc["n"] + n_skips(s)).alias("n"))

    return F.aggregate(segments(mm), start, add, lambda acc: acc["out"])


def descriptors(mm: Column) -> Column:
    """Array of the distinct descriptors that have skips."""
    return F.array_distinct(F.transform(F.filter(segments(mm), lambda s: F.contains(s, F.lit(","))), descriptor_of))


def _joined(parts: Column) -> Column:
    return F.concat(F.array_join(parts, ";"), F.lit(";"))


def rename(mm: Column, old: str, new: str) -> Column:
    """Replace a descriptor; the result ends with ';'. Null and empty strings stay."""
    done = F.transform(segments(mm), lambda s: F.when(F.contains(s, F.lit(",")) & (descriptor_of(s) == old), F.concat(F.lit(new), F.substring(s, F.length(descriptor_of(s)) + 1, F.length(s)))).otherwise(s))
    return F.when(F.size(segments(mm)) > 0, _joined(done)).otherwise(mm)


def remove(mm: Column, ml: Column, drop: list[str]) -> tuple[Column, Column]:
    """Drop descriptors and their qualities; what becomes empty is null."""
    table = segment_table(mm)
    kept = F.filter(table, lambda r: ~r["descriptor"].isin(*drop) & (r["skips"] != ""))
    text = F.transform(kept, lambda r: F.concat(r["descriptor"], F.lit(","), r["skips"]))
    left = F.flatten(F.transform(kept, lambda r: F.slice(ml, r["first"] + 1, F.size(F.split(r["skips"], ",")))))
    return F.when(F.size(text) > 0, _joined(text)), F.when(mm.isNull(), ml).when(F.size(left) > 0, left)


def append(mm: Column, ml: Column, other_mm: Column, other_ml: Column) -> tuple[Column, Column]:
    """Put the other tags behind these; a missing side counts as none."""
    both_mm = F.when(mm.isNull(), other_mm).when(other_mm.isNull(), mm).otherwise(F.concat(mm, other_mm))
    both_ml = F.when(ml.isNull(), other_ml).when(other_ml.isNull(), ml).otherwise(F.concat(ml, other_ml))
    return both_mm, both_ml


def checked(mm: Column, ml: Column) -> Column:
    """``mm``, failing the query where only one of the tags is present."""
    text = F.when(mm.isNull(), "a read has ML qualities but no MM tag").otherwise("a read has an MM tag but no ML qualities")
    return F.when(mm.isNull() != ml.isNull(), F.raise_error(text).cast("string")).otherwise(mm)


def header_tag(description: Column, tag: str) -> Column:
    """Value of ``TAG:TYPE:VALUE`` among the white-space separated fields of a header; the last one counts, null if none."""
    found = F.filter(F.split(description, r"\s+"), lambda x: x.rlike(rf"^{tag}:[^:]*:"))
    return F.regexp_replace(F.element_at(F.when(F.size(found) > 0, found), -1), rf"^{tag}:[^:]*:", "")


def ml_values(text: Column) -> Column:
    """Qualities of an ML value: the element type, then numbers from 0 to 255; anything else fails the query."""
    parts = F.split(text, ",")
    number = lambda x: F.when(x.rlike(r"^[0-9]{1,3}$") & (F.expr("0") <= x.try_cast("int")) & (x.try_cast("int") <= 255), x.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("Parse error: '"), x, F.lit("'"))).cast("int"))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), number)
