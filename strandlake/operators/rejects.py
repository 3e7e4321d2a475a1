"""Loading pileup lines: valid records on one side, rejected lines with a reason on the other.

Method: strict load plus anti-join. Every raw line keeps its offset. A strict
load takes only the lines that satisfy every rule. Subtracting the loaded
offsets from the raw offsets leaves the rejects, and only those are diagnosed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a pileup line, in order.
FIELDS = (
    "contig", "ref_start", "ref_end", "mod_type", "score", "strand", "start_pos", "end_pos", "color", "n_valid_cov",
    "fraction_modified", "n_modified", "n_canonical", "n_other_mod", "n_delete", "n_fail", "n_diff", "n_no_call",
)
INTEGERS = tuple(f for f in FIELDS if f not in ("contig", "mod_type", "strand", "color", "fraction_modified"))
MOD_TYPES = ("a", "m", "21839")
STRANDS = ("+", "-")
MAX_UINT = 4294967295

FRACTION_PATTERN = r"\A0*(?:[0-9]{1,2}(?:\.[0-9]+)?|100(?:\.0+)?)\z"
INTEGER_PATTERN = r"\A0*[0-9]{1,10}\z"


@dataclass(frozen=True)
class Loaded:
    """``records``: typed valid rows. ``rejects``: offset, line and reason. Both carry the offset columns."""

    records: DataFrame
    rejects: DataFrame


def _fields(line: Column) -> Column:
    """The line's raw fields; a tab between quotes is text.

    Cut at the quotes, every second part lies within quotes. There a tab is
    written as ``\\x01b`` (and ``\\x01`` itself as ``\\x01a``), so a plain split
    at tabs gives the fields, and ``_text`` turns the marks back.
    """
    parts = F.split(F.replace(line, F.lit("\x01"), F.lit("\x01a")), '"')
    hidden = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\t"), F.lit("\x01b"))).otherwise(p))
    return F.split(F.when(F.contains(line, F.lit('"')), F.array_join(hidden, '"')).otherwise(F.replace(line, F.lit("\x01"), F.lit("\x01a"))), "\t")


def _broken(raw: Column) -> Column:
    """A quote anywhere but around the field or doubled within it."""
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit(""))
    wrapped = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
    return F.contains(raw, F.lit('"')) & ~(wrapped & ~F.contains(inner, F.lit('"')))


def _text(raw: Column) -> Column:
    """The value of a raw field."""
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    value = F.when(raw.startswith('"'), inner).otherwise(raw)
    return F.when(F.contains(value, F.lit("\x01")), F.replace(F.replace(value, F.lit("\x01b"), F.lit("\t")), F.lit("\x01a"), F.lit("\x01"))).otherwise(value)


def _uint(value: Column) -> Column:
    """The number, or null unless it is digits 0-9 with a value up to MAX_UINT."""
    number = F.when(value.rlike(INTEGER_PATTERN), value.try_cast("bigint"))
    return F.when(number <= MAX_UINT, number)


def is_record_line(stripped_line: Column) -> Column:
    """Whether the stripped line is meant as a record: not empty, no comment, no track or browser line."""
    skip = (stripped_line == "") | stripped_line.startswith("#") | stripped_line.startswith("track") | stripped_line.startswith("browser")
    return F.coalesce(~skip, F.lit(False))


def _offset(offsets: list[str]) -> list[Column]:
    """Null-safe key of a raw row: its offsets and a 128-bit fingerprint of its line.

    Rows repeated with the same line share a key and a verdict; rows that
    share only the offset don't hide each other.
    """
    return [*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"_o{i}") for i, c in enumerate(offsets)), F.unhex(F.md5(F.col("_line").cast("binary"))).alias("_print")]


def load_pileup_lines(lines: DataFrame, line: str = "line", offsets: tuple[str, ...] = ("line_id",)) -> Loaded:
    """Split raw pileup lines into typed records and rejects.

    ``lines`` may have any other columns, also ones named like the fields; only
    ``line`` and ``offsets`` are read. Lines that are null, blank, comments,
    ``track`` or ``browser`` lines are in neither result. Repeated rows give
    repeated results. An empty table gives two empty results. A reject's
    ``reason`` is the first rule it misses: ``columns``, ``quoting``,
    ``contig``, ``mod_type``, ``strand``, ``fraction``, ``integer`` or
    ``modified_over_coverage``.
    """
    names = list(offsets)
    # generated, so that a line is trimmed once and not once per rule
    trimmed = F.array(F.btrim(F.col(f"`{line}`"), F.lit(" \t\r\n")))
    raw = lines.select(*(F.col(f"`{c}`").alias(f"off{i}") for i, c in enumerate(names)), F.explode(F.filter(trimmed, is_record_line)).alias("_line"))
    cols = [f"off{i}" for i in range(len(names))]

    # one generator reads, checks and types a line, so that no step of it is evaluated twice
    whole = F.filter(F.array(_fields(F.col("_line"))), lambda raw: (F.size(raw) == len(FIELDS)) & ~F.exists(raw, _broken))
    typed = F.transform(F.transform(whole, lambda raw: F.transform(raw, _text)), _record)
    loaded = raw.select(*cols, "_line", F.inline(F.filter(typed, _conforms)))

    keys = [f"_o{i}" for i in range(len(cols))] + ["_print"]
    remainder = raw.select("*", *_offset(cols)).join(loaded.select(*_offset(cols)), keys, "left_anti")
    rejects = remainder.select(*(F.col(c).alias(n) for c, n in zip(cols, names)), F.col("_line").alias("line"), _diagnosis(F.col("_line")).alias("reason"))
    records = loaded.select(*(F.col(c).alias(n) for c, n in zip(cols, names)), *(F.col(f"v_{f}").alias(f) for f in FIELDS))
    return Loaded(records, rejects)


def _record(values: Column) -> Column:
    """The typed fields; null where a number isn't one."""
    cols = []
    for i, f in enumerate(FIELDS):
        v = F.get(values, F.lit(i))
        cols.append((_uint(v) if f in INTEGERS else F.when(v.rlike(FRACTION_PATTERN), v.try_cast("double")) if f == "fraction_modified" else v).alias(f"v_{f}"))
    return F.struct(*cols)


def _conforms(record: Column) -> Column:
    v = lambda f: record.getField(f"v_{f}")
    good = (v("contig") != "") & v("mod_type").isin(*MOD_TYPES) & v("strand").isin(*STRANDS) & v("fraction_modified").isNotNull() & (v("n_modified") <= v("n_valid_cov"))
    for f in INTEGERS:
        good &= v(f).isNotNull()
    return good


def _diagnosis(line: Column) -> Column:
    """The first rule that the line misses."""
    return F.get(F.transform(F.array(_fields(line)), _first_miss), F.lit(0))


def _first_miss(raw: Column) -> Column:
    value = lambda f: F.coalesce(_text(F.get(raw, F.lit(FIELDS.index(f)))), F.lit(""))
    bad_int = F.exists(F.array(*(F.lit(FIELDS.index(f)) for f in INTEGERS)), lambda i: _uint(F.coalesce(_text(F.get(raw, i)), F.lit(""))).isNull())
    return (
        F.when(F.exists(raw, _broken), F.lit("quoting"))
        .when(F.size(raw) != len(FIELDS), F.lit("columns"))
        .when(value("contig") == "", F.lit("contig"))
        .when(~value("mod_type").isin(*MOD_TYPES), F.lit("mod_type"))
        .when(~value("strand").isin(*STRANDS), F.lit("strand"))
        .when(~value("fraction_modified").rlike(FRACTION_PATTERN), F.lit("fraction"))
        .when(bad_int, F.lit("integer"))
        .otherwise(F.lit("modified_over_coverage"))
    )
