"""Pileup lines: strict load, rejects and their reasons, against a scanner that reads letter by letter."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators.rejects import FIELDS, INTEGERS, load_pileup_lines

GOOD = ["c1", "5", "6", "a", "9", "+", "5", "6", "255,0,0", "9", "88.89", "8", "1", "0", "0", "0", "0", "0"]


def line(**changes):
    values = dict(zip(FIELDS, GOOD)) | changes
    return "\t".join(values[f] for f in FIELDS)


def scan(text):
    """Fields by one pass over the letters, or None where quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(text) and text[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(text):
                    return None
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            if i < len(text) and text[i] != "\t":
                return None
        else:
            j = text.find("\t", i)
            value, i = (text[i:], len(text)) if j < 0 else (text[i:j], j)
            if '"' in value:
                return None
        out.append(value)
        if i >= len(text):
            return out
        i += 1


def expected(text):
    """None: no record; else whether it is valid."""
    text = (text or "").strip(" \t\r\n")
    if not text or text.startswith(("#", "track", "browser")):
        return None
    f = scan(text)
    if f is None or len(f) != 18:
        return False
    v = dict(zip(FIELDS, f))
    digits = lambda x: x.isascii() and x.isdigit()
    whole, _, part = v["fraction_modified"].partition(".")
    ok = v["contig"] != "" and v["mod_type"] in ("a", "m", "21839") and v["strand"] in "+-" and len(v["strand"]) == 1
    ok = ok and digits(whole) and (digits(part) or "." not in v["fraction_modified"]) and (int(whole) < 100 or int(whole) == 100 and not part.strip("0"))
    ok = ok and all(digits(v[k]) and int(v[k]) <= 4294967295 for k in INTEGERS)
    return ok and int(v["n_modified"]) <= int(v["n_valid_cov"])


CASES = [
    (line(), None), (" \t\r\n" + line() + "\r\n", None), (line(contig='"a""b\tc"'), None), (line(color=""), None), (line(color='"'), "quoting"), (line(color='a"b'), "quoting"), (line(color='"a"b'), "quoting"),
    (line(color='"a'), "quoting"), (line(color='""""'), None), (line(color='"""'), "quoting"), (line(contig='""'), "contig"), (line() + "\t1", "columns"), (line().replace("\t", " "), "columns"),
    (line(contig=" "), "columns"), (line(mod_type="h"), "mod_type"), (line(mod_type="021839"), "mod_type"), (line(strand="."), "strand"), (line(fraction_modified="100.0"), None), (line(fraction_modified="100.00000000000000000000000001"), "fraction"),
    (line(fraction_modified="0000100"), None), (line(fraction_modified="1e1"), "fraction"), (line(fraction_modified=".5"), "fraction"), (line(fraction_modified="5."), "fraction"), (line(fraction_modified="nan"), "fraction"),
    (line(score="-1"), "integer"), (line(score="4294967295"), None), (line(score="4294967296"), "integer"), (line(score="0" * 40 + "7"), None), (line(score="٣"), "integer"), (line(score=" 3"), "integer"), (line(score="3\n"), "integer"),
    (line(n_modified="10"), "modified_over_coverage"), (line(contig="x\x01b"), None), (line(contig='"x\x01b\ty\x01a"'), None), (line(contig="c" * 200_000), None), (line(color='"' + '""' * 50_000 + '"'), None),
    (line(contig="\x01") + '\t"', "quoting"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "line_id long, line string")
    out = load_pileup_lines(df)
    got = {r["line_id"]: r["reason"] for r in out.rejects.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES) if reason}
    records = {r["line_id"]: r for r in out.records.collect()}
    assert set(records) == {i for i, (_, reason) in enumerate(CASES) if not reason}
    assert records[2]["contig"] == 'a"b\tc' and records[0]["n_modified"] == 8 and records[0]["fraction_modified"] == 88.89
    tricky = next(i for i, (t, _) in enumerate(CASES) if t.startswith('"x\x01b'))
    assert records[tricky]["contig"] == "x\x01b\ty\x01a"


def test_skipped_lines_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \r\n", "x", "y"), (4, "# no", "x", "y"), (5, "track a", "x", "y"), (6, "browser", "x", "y"), (7, line(), "x", "y"), (7, line(), "x", "y"), (8, "bad", "x", "y"), (8, "bad", "x", "y"), (8, line(), "x", "y"), (None, "worse", "x", "y"), (None, line(), "x", "y")]
    df = spark.createDataFrame(rows, "line_id long, line string, contig string, off0 string")
    out = load_pileup_lines(df)
    assert sorted((r["line_id"] or 0, r["line"]) for r in out.rejects.collect()) == [(0, "worse"), (8, "bad"), (8, "bad")]
    assert sorted(r["line_id"] or 0 for r in out.records.collect()) == [0, 7, 7, 8]


def test_empty(spark):
    out = load_pileup_lines(spark.createDataFrame([], "line_id long, line string"))
    assert out.rejects.count() == 0 and out.records.count() == 0
    assert out.records.columns == ["line_id", *FIELDS]


def test_against_scanner(spark):
    rng = random.Random(5)
    lines = []
    for i in range(3000):
        t = list(line())
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(['"', '""', "\t", "x", "9", "-", "", "\r", '"\t', "."])
        lines.append((i, "".join(t)))
    df = spark.createDataFrame(lines, "line_id long, line string")
    out = load_pileup_lines(df)
    assert {r[0] for r in out.rejects.select("line_id").collect()} == {i for i, t in lines if expected(t) is False}
    assert {r[0] for r in out.records.select("line_id").collect()} == {i for i, t in lines if expected(t)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a"\t', max_size=12))
def test_scanner_and_parity_agree_on_quoting(text):
    """The operator's way of reading quotes, in Python: parity of quotes decides which tabs are text."""
    parts = text.split('"')
    marked = '"'.join(p.replace("\t", "\0") if i % 2 else p for i, p in enumerate(parts))
    fields = marked.split("\t")
    broken = any('"' in f and not (len(f) >= 2 and f[0] == f[-1] == '"' and '"' not in f[1:-1].replace('""', "")) for f in fields)
    assert broken == (scan(text) is None)


@pytest.mark.parametrize("text,want", CASES[:20])
def test_expected_knows_the_cases(text, want):
    assert expected(text) == (want is None)
