"""Reading level of texts.

Method: every sentence of a text is classified by two regularised models, one on
characters (n-grams within words) and one on words and word pairs; the sentence
distributions, weighted by their words, are aggregated to one distribution per
document, which a calibrated model turns into a level.

Texts are parsed and scored many at a time on arrays of code points: words are
known by a 64-bit hash of their letters, and sentences are ranges of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.own_words import own_words

LEVELS = 5
FEATURES = 1 << 15
#: Bound of the sample that the models are fitted on; nothing else is sampled.
MAX_LABELLED = 3000
EPOCHS, SENTENCES_PER_STEP, RATE, PENALTY = 6, 512, 0.5, 1e-5
#: Features of a sentence are scaled so, which sets how sure the models may be.
SCALE = 8.0
#: Texts are parsed together up to about this many characters.
CHUNK = 1 << 20

_LETTER, _JOINER, _STOP, _SPACE, _LINE, _UNSEEN = 1, 2, 4, 8, 16, 255
_classes = np.full(0x110000, _UNSEEN, dtype=np.uint8)


def _class(code: int) -> int:
    """Letters make words, with apostrophes and hyphens between them; white space after a stop ends a sentence, as a line break does."""
    c = chr(code)
    if c.isalnum() and not c.isdecimal():
        return _LETTER
    return _JOINER * (c in "'’-") | _STOP * (c in ".!?;:") | _SPACE * c.isspace() | _LINE * (c == "\n")


def _classes_of(codes: np.ndarray) -> np.ndarray:
    out = _classes[codes]
    if (out == _UNSEEN).any():
        for code in np.unique(codes[out == _UNSEEN]).tolist():
            _classes[code] = _class(code)
        out = _classes[codes]
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _feature(h: np.ndarray) -> np.ndarray:
    return (_mixed(h) % np.uint64(FEATURES)).astype(np.int32)


@dataclass
class Sentences:
    """Sentences of some texts, in order; those without words are left out.

    ``words``: hash of each word. ``starts``: each sentence's first word.
    ``owner``: the text of each sentence. ``codes``, ``begins``, ``ends``: the
    letters of each word.
    """

    words: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.words)))


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in groups of about CHUNK characters, with their places; a longer text is cut between its lines."""
    group, at, size = [], [], 0
    for i, text in enumerate(texts):
        pieces = [text] if len(text) <= CHUNK else text.split("\n")
        for p in pieces:
            if size and size + len(p) > CHUNK:
                yield group, at
                group, at, size = [], [], 0
            group.append(p)
            at.append(i)
            size += len(p) + 1
    if group:
        yield group, at


def parse(texts: list[str]) -> Iterator[Sentences]:
    """The sentences of all texts, in lower case, in chunks of bounded size but for a single longer line."""
    for group, at in _parts(texts):
        low = [t.lower() for t in group]
        joined = "\n".join(low)
        codes = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(codes):
            continue
        kind = _classes_of(codes)
        letter = np.zeros(len(codes) + 2, dtype=bool)
        letter[1:-1] = kind & _LETTER
        inside = letter.copy()
        inside[1:-1] |= (kind & _JOINER).astype(bool) & letter[:-2] & letter[2:]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        if not len(begins):
            continue
        breaks = (kind & _LINE).astype(bool)
        breaks[1:] |= (kind[1:] & _SPACE).astype(bool) & (kind[:-1] & _STOP).astype(bool)
        sentence = np.cumsum(breaks, dtype=np.int32)[begins]
        new = np.concatenate(([True], sentence[1:] != sentence[:-1]))
        starts = np.flatnonzero(new)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
        owner = np.array(at)[np.searchsorted(offsets, begins[starts], side="right") - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)))
        words = (sums[ends] - sums[begins]) * _powers(_INVERSE, len(codes))[begins]
        yield Sentences(_mixed(words), starts, owner, codes, begins, ends)


def character_tables(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words, one after the other, and the number of each word's: n-grams of 2 to 5 letters, with marks at both ends."""
    lengths = ends - begins + 2
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = int(lengths.sum())
    place = np.arange(total) - np.repeat(first, lengths)
    end = np.repeat(lengths, lengths)
    at = np.clip(np.repeat(begins, lengths) + place - 1, 0, len(codes) - 1)
    letters = codes[at].astype(np.uint64) + np.uint64(2)
    letters[place == 0], letters[place == end - 1] = 0, 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    found, of = [], []
    h = letters.copy()
    for n in (2, 3, 4, 5):
        h = h[:-1] * _BASE + letters[n - 1 :] if len(h) else h
        whole = np.flatnonzero((place + n <= end)[: len(h)])
        found.append(_feature(h[whole] + np.uint64(n)))
        of.append(owner[whole])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(found)[order], np.bincount(of_all, minlength=len(lengths))


def character_features(word: str) -> list[int]:
    codes = np.array([ord(c) for c in word], dtype=np.uint32)
    return character_tables(codes, np.array([0]), np.array([len(codes)]))[0].tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


class _Grouped:
    """Sums of rows by an index, with the order worked out once."""

    def __init__(self, index: np.ndarray) -> None:
        self.order = np.argsort(index, kind="stable")
        ordered = index[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        self.keys = ordered[self.first]

    def sum(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.order], self.first, axis=0)


@dataclass
class Linear:
    """A softmax regression on hashed features of sentences."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, LEVELS), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(LEVELS, dtype=np.float32))


class _Rows:
    """Sentences as features: each sentence has the mean of its units, each unit the mean of its features.

    The units of the model on characters are the distinct words, with their
    n-grams; those of the model on words are features themselves.
    """

    def __init__(self, s: Sentences, kind: str) -> None:
        n = s.sizes
        if kind == "characters":
            self.words, at, self.tokens = np.unique(s.words, return_index=True, return_inverse=True)
            self.features, self.counts = character_tables(s.codes, s.begins[at], s.ends[at])
            self.starts, self.scale = s.starts, (SCALE / n).astype(np.float32)
        else:
            last = np.zeros(len(s.words), dtype=bool)
            last[np.append(s.starts[1:], len(s.words)) - 1] = True
            following = np.concatenate((s.words[1:], s.words[:1]))
            pair = _feature(s.words * _BASE + following)
            both = np.stack((_feature(s.words), pair), axis=1).ravel()
            keep = np.ones(len(both), dtype=bool)
            keep[1::2] = ~last
            self.tokens, self.features = both[keep], None
            self.starts, self.scale = _starts(2 * n - 1), (SCALE / (2 * n - 1)).astype(np.float32)

    def units(self, weights: np.ndarray) -> np.ndarray:
        if self.features is None:
            return weights
        return np.add.reduceat(weights[self.features], _starts(self.counts), axis=0) / self.counts[:, None].astype(np.float32)

    def log_odds(self, model: Linear) -> np.ndarray:
        return np.add.reduceat(self.units(model.weights)[self.tokens], self.starts, axis=0) * self.scale[:, None] + model.bias

    def prepared(self) -> _Rows:
        """For repeated gradients."""
        self.sizes = np.diff(np.append(self.starts, len(self.tokens)))
        self.by_unit = _Grouped(self.tokens)
        self.by_feature = None if self.features is None else _Grouped(self.features)
        return self

    def gradient(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and the gradient of their weights, from that of the sentences' log-odds."""
        g = self.by_unit.sum(np.repeat(d * self.scale[:, None], self.sizes, axis=0))
        if self.by_feature is None:
            return self.by_unit.keys, g
        return self.by_feature.keys, self.by_feature.sum(np.repeat(g / self.counts[:, None].astype(np.float32), self.counts, axis=0))


def _fit_linear(steps: list[tuple[_Rows, np.ndarray, np.ndarray]], seed: int) -> Linear:
    """Adagrad on the cross-entropy with an L2 penalty. A step: rows, a distribution over levels and a weight per sentence."""
    model, rng = Linear(), np.random.default_rng(seed)
    grad2, grad2_b = np.full_like(model.weights, 1e-6), np.full_like(model.bias, 1e-6)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(steps)):
            rows, targets, weight = steps[i]
            d = ((_softmax(rows.log_odds(model)) - targets) * weight[:, None] / len(weight)).astype(np.float32)
            keys, g = rows.gradient(d)
            g += PENALTY * model.weights[keys]
            grad2[keys] += g * g
            model.weights[keys] -= RATE * g / np.sqrt(grad2[keys])
            gb = d.sum(axis=0)
            grad2_b += gb * gb
            model.bias -= RATE * 0.1 * gb / np.sqrt(grad2_b)
    return model


@dataclass
class Model:
    """Both sentence models and the calibration of documents."""

    characters: Linear
    words: Linear
    calibration: np.ndarray | None = None

    def sentence_distributions(self, s: Sentences) -> np.ndarray:
        return (_softmax(_Rows(s, "characters").log_odds(self.characters)) + _softmax(_Rows(s, "words").log_odds(self.words))) / 2

    def document_features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the sentences' distributions averaged by words, their logarithms and 1; the numbers of sentences and of words."""
        sums, sentences, words = np.zeros((len(texts), LEVELS)), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for s in parse(texts):
            n = s.sizes
            at = np.flatnonzero(np.concatenate(([True], s.owner[1:] != s.owner[:-1])))
            owner = s.owner[at]
            sums[owner] += np.add.reduceat(self.sentence_distributions(s) * n[:, None], at, axis=0)
            sentences[owner] += np.diff(np.append(at, len(n)))
            words[owner] += np.add.reduceat(n, at)
        mean = sums / np.maximum(words, 1)[:, None]
        return np.concatenate((mean, np.log(mean + 0.01), np.ones((len(texts), 1))), axis=1), sentences, words

    def document_distributions(self, x: np.ndarray) -> np.ndarray:
        return x[:, :LEVELS] if self.calibration is None else _softmax(x @ self.calibration)


def middle_levels(p: np.ndarray) -> np.ndarray:
    """The level that splits each distribution in half."""
    return (np.cumsum(p, axis=1) < 0.5 * p.sum(axis=1, keepdims=True)).sum(axis=1) + 1


def _fit_sentences(texts: list[str], targets: np.ndarray, weight: np.ndarray, seed: int) -> Model:
    """Both models on all sentences of the texts."""
    order = np.random.default_rng(seed).permutation(len(texts))
    # the texts of one step, by their characters: a sentence has about 80
    size = np.cumsum([len(texts[i]) + 1 for i in order]) // (80 * SENTENCES_PER_STEP) if len(texts) else np.zeros(0, dtype=np.int64)
    steps: dict[str, list] = {"characters": [], "words": []}
    for k in np.unique(size):
        ids = order[size == k]
        for s in parse([texts[i] for i in ids]):
            of = ids[s.owner]
            for kind, out in steps.items():
                out.append((_Rows(s, kind).prepared(), targets[of].astype(np.float32), weight[of].astype(np.float32)))
    return Model(_fit_linear(steps["characters"], seed), _fit_linear(steps["words"], seed))


def _calibrate(x: np.ndarray, targets: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """L2-regularised softmax regression by gradient descent with momentum."""
    w, step = np.zeros((x.shape[1], LEVELS)), np.zeros((x.shape[1], LEVELS))
    for _ in range(1500):
        g = x.T @ ((_softmax(x @ w) - targets) * weight[:, None]) / weight.sum() + penalty * w
        step = 0.9 * step - 0.3 * g
        w += step
    return w


def fit(anchors: list[tuple[int, str]], labelled: list[tuple[str, list[int]]], seed: int = 0) -> Model:
    """Fit on anchor passages (level, text) and labelled texts (text, number of ratings at each of the five levels).

    Two pairs of sentence models are fitted, each on one half of the texts; the
    result is their mean. The calibration is fitted on documents that the
    sentence models haven't seen, as each half is predicted by the models of the
    other. Models and calibration take all sentences of every text, as scoring
    does. Ratings of one text are averaged, so that raters who err weigh little.
    """
    texts = [(t, np.bincount([level - 1], minlength=LEVELS).astype(float), 3.0) for level, t in anchors]
    texts += [(own_words(t), np.array(n) / sum(n), min(sum(n), 3) / 2) for t, n in labelled if sum(n)]
    worded = set().union(*(s.owner.tolist() for s in parse([t for t, _, _ in texts])))
    texts = [x for i, x in enumerate(texts) if i in worded]
    if not texts:
        raise ValueError("there is nothing to fit on")
    targets, weight = np.array([y for _, y, _ in texts]), np.array([w for _, _, w in texts])
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    x = np.zeros((len(texts), 2 * LEVELS + 1))
    models = []
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        m = _fit_sentences([texts[i][0] for i in other], targets[other], weight[other], seed)
        x[own] = m.document_features([texts[i][0] for i in own])[0]
        models.append(m)
    mean = lambda kind: Linear(*((getattr(getattr(models[0], kind), a) + getattr(getattr(models[1], kind), a)) / 2 for a in ("weights", "bias")))
    return Model(mean("characters"), mean("words"), _calibrate(x, targets, weight))


def fit_tables(docs: DataFrame, labels: DataFrame, anchors: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the tables: all anchors (a small fixed table) and at most ``max_labelled`` labelled documents, chosen by hash of their id, with their whole texts.

    Labels that are null or outside 1 to 5 are left out; a repeated label of one
    rater counts once.
    """
    valid = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    rated = valid.select("doc_id", "rater", "reading_level").distinct().groupBy("doc_id").agg(*(F.count_if(F.col("reading_level") == i).alias(f"n{i}") for i in range(1, LEVELS + 1)))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", *(f"n{i}" for i in range(1, LEVELS + 1))).collect()
    fixed = anchors.where(F.col("reading_level").between(1, LEVELS) & F.col("text").isNotNull()).orderBy("reading_level", "text").select("reading_level", "text").collect()
    return fit([(r[0], r[1]) for r in fixed], [(r["text"] or "", list(r[1:])) for r in rows])


def reading_levels(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """The level of each document's own words.

    Columns: ``key`` (as given), ``reading_level`` 1 to 5 (the middle of the
    calibrated distribution), ``difficulty`` (mean
    level of the calibrated distribution), ``n_sentences``, ``n_words``. A text
    without own words, also null or empty, has null level and difficulty and no
    sentences. Every row gives one row; repeated rows and null keys are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of FEATURES x 5 numbers

    @F.pandas_udf("reading_level int, difficulty double, n_sentences int, n_words int")
    def level(texts: pd.Series) -> pd.DataFrame:
        x, sentences, words = shared.value.document_features([own_words(t) for t in texts])
        p = shared.value.document_distributions(x)
        frame = pd.DataFrame({"reading_level": middle_levels(p), "difficulty": p @ np.arange(1, LEVELS + 1), "n_sentences": sentences, "n_words": words})
        frame = frame.astype({"reading_level": "Int32", "difficulty": "Float64", "n_sentences": "int32", "n_words": "int32"})
        frame.loc[words == 0, ["reading_level", "difficulty"]] = pd.NA
        return frame

    scored = docs.select(F.col(f"`{key}`").alias("_key"), level(F.col(f"`{text}`")).alias("_r"))
    return scored.select(F.col("_key").alias(key), "_r.*")
