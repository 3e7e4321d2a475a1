"""Own words of posts, and reading levels on held-out data."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.llm import reading
from strandlake.llm.own_words import own_words
from strandlake.llm.tokens import n_tokens

CASES = [
    ("Hello there.", "Hello there."), (None, ""), ("", ""), ("  \n", ""), ("[deleted]", ""), ("(post deleted by author)", ""), ("[removed by moderator]", ""), ("<deleted>", ""),
    ("> quoted\n> more\n\nMine.", "Mine."), ("> > deep\n>> deeper\nMine.", "Mine."), ("| piped\nMine.", "Mine."), ("bob wrote:\n> his\n\nMine.", "Mine."), ("On 2024-01, bob wrote:\n>his\nMine.", "Mine."), ("bob wrote a letter.", "bob wrote a letter."),
    ("[quote=bob]his\nwords[/quote]\nMine.", "Mine."), ('[QUOTE="bob"]a [quote=eve]b[/quote] c[/QUOTE] Mine.', "Mine."), ("[quote=a][quote=b]cut off[/quote]\nMine.", "Mine."), ("[quote=a]x[/quote]\nMine.\n[quote=b][quote=c]cut[/quote]\nToo.", "Mine.\nToo."),
    ("<blockquote>his</blockquote>\nMine.", "Mine."), ("<blockquote>a\n> [quote=x]b</blockquote>\nMine.", "Mine."), ("[quote=a]>> eve said\n>> b[/quote]\nMine.", "Mine."), ("> [quote=a]cut\n\nMine.", "Mine."),
    ("Quote from: bob\n----------\nhis\n----------\nMine.", "Mine."), ("Mine.\n\n-- \nbob\nmotto", "Mine."), ("Mine.\n____________\nbob | motto", "Mine."), ("Mine.\n~ bob ~\nmotto", "Mine."), ("Mine.\n[sig]bob: motto[/sig]", "Mine."),
    ("Mine.\n[code]\nx = 1\n[/code]\nToo.", "Mine.\nToo."), ("Mine.\n```\nx = 1\n```\nToo.", "Mine.\nToo."), ("> [code]\n> x\n\nMine.", "Mine."), ("Mine. http://a.example/x?y=1 Too.", "Mine.   Too."), ("<p>Mine.</p><p>Too.</p>", "Mine.\nToo."),
    ("Mine&nbsp;is &amp; was.", "Mine is & was."), ("a\t1\t2\nMine.", "Mine."), ("12 34 56 a\nMine.", "Mine."), ("[b]Mine.[/b]", "Mine."), ("- Item one\n- Item two", "- Item one\n- Item two"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_own_words(text, want):
    assert own_words(text) == want


@pytest.mark.parametrize("text", ["[quote]" * 20_000 + "x", "<" * 200_000, "> " * 100_000, "[" * 200_000, "a" * 500_000, "~ " * 100_000, "<a " * 100_000, "www." * 50_000, "\n" * 200_000, "& " * 100_000])
def test_long_odd_texts_end(text):
    own_words(text)


def labelled(n=60, seed=0):
    rng = random.Random(seed)
    words = {1: "cat dog red sun hat", 2: "garden window kitchen bottle manual", 3: "pipeline threshold coverage adapter report", 4: "consequently investigation methodology evidently comparison", 5: "hermeneutically ontologically idiosyncratic overparameterization epistemological"}
    out = []
    for _ in range(n):
        level = rng.randrange(1, 6)
        pool = words[level].split() * 4 + words[max(1, level - 1)].split()
        out.append((level, " ".join(" ".join(rng.choices(pool, k=7)).capitalize() + "." for _ in range(4))))
    return out


def test_fit_and_predict(spark):
    model = reading.fit(labelled(50), [(t, [int(level == i) for i in range(1, 6)]) for level, t in labelled(50, 1)])
    rows = [(i, t, "k") for i, (_, t) in enumerate(labelled(40, 2))] + [(100, None, "k"), (101, "", "k"), (102, "> only quoted", "k"), (None, "The cat. The dog.", "k")]
    df = spark.createDataFrame(rows, "id long, body string, reading_level string")
    got = {r["id"]: r for r in reading.reading_levels(df, "id", "body", model).collect()}
    assert sum(got[i]["reading_level"] == level for i, (level, _) in enumerate(labelled(40, 2))) >= 36
    assert all(got[i]["reading_level"] is None and got[i]["n_words"] == 0 for i in (100, 101, 102)) and got[None]["n_sentences"] == 2
    assert reading.reading_levels(df.limit(0), "id", "body", model).collect() == []
    again = reading.fit(labelled(50), [(t, [int(level == i) for i in range(1, 6)]) for level, t in labelled(50, 1)])
    assert (again.words.weights == model.words.weights).all() and (again.calibration == model.calibration).all()
    with pytest.raises(ValueError):
        reading.fit([], [])


def test_fit_tables_bounds_and_dirty_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(labelled(30))] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", level) for i, (level, _) in enumerate(labelled(30))] * 2 + [(1, "q", None), (2, "q", 9), (None, "q", 1), (99, "q", 2)], "doc_id long, rater string, reading_level int")
    anchors = spark.createDataFrame([(i, level, t) for i, (level, t) in enumerate(labelled(30, 5))] + [(77, None, "x"), (78, 1, None)], "anchor_id int, reading_level int, text string")
    assert reading.fit_tables(docs, labels, anchors, max_labelled=10).calibration is not None
    assert reading.fit_tables(docs.limit(0), labels, anchors).calibration is not None


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """Fit on labels of odd documents; of even ones with two or more ratings, nearly all agree on level 4 or more."""
    docs, labels, anchors = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "reading_labels", "level_anchors"))
    model = reading.fit_tables(docs, labels.where("doc_id % 2 = 1"), anchors, max_labelled=400)
    rated = labels.where("doc_id % 2 = 0 and reading_level is not null").groupBy("doc_id").agg(F.median("reading_level").alias("m"), F.count("*").alias("n")).where("n >= 2 and m <> 3.5")
    held = docs.join(F.broadcast(rated), "doc_id")
    got = reading.reading_levels(held, "doc_id", "text", model).join(rated, "doc_id").collect()
    right = sum((r["reading_level"] or 0) >= 4 if r["m"] >= 4 else (r["reading_level"] or 0) < 4 for r in got)
    assert len(got) > 100 and right / len(got) >= 0.97


def test_tokens(spark):
    texts = [None, "", "Hello world", "<|endoftext|>", "a" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_tokens(F.col("t"))).collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 1 and got[4] > 1000


def test_long_words_keep_their_end():
    start = "a" * 64
    assert len(reading.character_features(start + "xyz")) > len(reading.character_features(start))
    assert reading.character_features(start + "xyz") != reading.character_features(start + "ions")


def test_long_signatures():
    sign = "\n".join(f"motto {'abcdefghijkl'[i]}" for i in range(12))
    assert own_words(f"Mine.\n-- \n{sign}") == "Mine."
    assert own_words(f"Mine.\n--\n{sign}").endswith("motto l")  # only a separator


def test_fit_reads_all_sentences():
    """What tells the levels apart comes after 40 sentences that all texts share."""
    same = "The plain text is here. " * 40
    texts = [(same + t * 3, [int(level == i) for i in range(1, 6)]) for level, t in labelled(60, 1)]
    model = reading.fit([], texts)
    tails = labelled(40, 2)
    got = reading.middle_levels(model.document_distributions(model.document_features([t for _, t in tails])[0]))
    assert sum(abs(g - level) <= 1 for g, (level, _) in zip(got, tails)) >= 34


def test_one_text_is_enough():
    model = reading.fit([(4, "Only one passage. It has two sentences.")], [])
    x, sentences, words = model.document_features(["Only one passage.", "", "1 2 3"])
    assert model.calibration is not None and sentences.tolist() == [1, 0, 0] and words.tolist() == [3, 0, 0]


def plain_sentences(text):
    found = (re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", s) for s in re.split(r"(?<=[.!?;:])\s+|\n+", text.lower()))
    return [words for words in found if words]


def words_of(s):
    return ["".join(map(chr, s.codes[a:b])) for a, b in zip(s.begins, s.ends)]


PARSED = ["", "One. Two three!  Four?\n\nFive; six: 7 seven", "don't well-known --a-- b'", "Ärger über çédille. ſtraße İi", "x_y a1b 2c. d.e . f", "no end", ".", "a.\n b", "É" * 50 + ". " + "q’s ’s"]


@pytest.mark.parametrize("chunk", [1 << 20, 10, 1])
def test_parse(monkeypatch, chunk):
    monkeypatch.setattr(reading, "CHUNK", chunk)
    got = [[] for _ in PARSED]
    for s in reading.parse(PARSED):
        words = words_of(s)
        for owner, a, n in zip(s.owner, s.starts, s.sizes):
            got[owner].append(words[a : a + n])
    assert got == [plain_sentences(t) for t in PARSED]


def test_scores_do_not_depend_on_chunks(monkeypatch):
    model = reading.fit(labelled(30), [])
    texts = ["\n".join(t for _, t in labelled(20, k)) for k in range(5)] + ["", "Last one."]
    whole = model.document_features(texts)
    monkeypatch.setattr(reading, "CHUNK", 100)
    parts = model.document_features(texts)
    assert all((a == b).all() for a, b in zip(whole[1:], parts[1:])) and abs(whole[0] - parts[0]).max() < 1e-5


def test_words_are_told_apart_by_all_their_letters():
    (s,) = reading.parse(["abc acb bca ab abc a’b a'b " + "x" * 300 + " " + "x" * 301])
    words = words_of(s)
    assert len(set(s.words.tolist())) == len(set(words)) == 8 and s.words[0] == s.words[4]


@pytest.mark.parametrize("text", ["[quote " * 50_000, "<blockquote " * 50_000, "[sig]" * 50_000, "[/quote]" * 50_000, "[quote]<blockquote>[/quote]" * 30_000, "on a, " * 50_000 + "wrote:\n> x", "~ a " * 50_000, "<" + "\n" * 200_000, "a." * 100_000 + "/", "[size=1] edited " * 30_000, "<code " * 50_000])
def test_odd_texts_without_bounds_end(text):
    own_words(text)


def test_names_of_any_length():
    name = "n" * 300
    assert own_words(f"{name} wrote:\n> his\n\nMine.") == "Mine."
    assert own_words(f'[quote="{name}"]his[/quote] Mine.') == "Mine." and own_words(f"Mine.\n~ {name} ~\nmotto") == "Mine."
    assert own_words("See docs.python.dev/3/x and a.example for it.") == "See   and   for it."
    assert own_words("Mine.\n--\none\ntwo\nthree", sign_lines=2).endswith("three") and own_words("Mine.\n--\none\ntwo", sign_lines=2) == "Mine."
