"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document is labelled. A sentence's
probability is a logistic function of its words; a document's is the noisy-or of
its sentences, ``1 - prod(1 - p)``. Both are trained together from document
labels, so the model finds the sentences that make a document toxic, and scoring
says which they are.

Training reads a bounded sample: of each label the ``per_label`` documents that
come first in hash order, without texts over ``max_chars``. Each class is
weighted back to its share of all labelled rows. One task fits the weights of at
most ``max_words`` words; they are all that reaches the driver. Scoring covers
every whole text and moves no rows.

Defined cases: NULL or empty text is one empty sentence. Label rows with a NULL
id or label, and ids without a document, are not used. With no positive or no
negative example the score is the share of positives (0 without any label).
Repeated documents get equal scores. Extra columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderboard.llm.tables import whole_row

PER_LABEL = 3000
MAX_CHARS = 200_000
MAX_WORDS = 2000
MIN_DOCS = 5
MIN_Z = 5.0
RIDGE = 2e-5
STEPS = 300
THRESHOLD = 0.7
OFFENDING = 0.5
PREFIXES = (3, 4, 5, 6)
MAX_REMEMBERED = 500_000
BLOCK_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")

SCORED = "score double, sentences array<struct<begin: long, end: long, score: double>>"


def features(word: str) -> list[str]:
    """The word itself and its beginnings, so that inflected forms share what is learnt."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


class _WordWeights(dict):
    """A word's total weight, worked out when it is first met; bounded."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self._weights = weights

    def __missing__(self, word: str) -> float:
        total = sum(self._weights.get(f, 0.0) for f in features(word))
        if len(self) < MAX_REMEMBERED:
            self[word] = total
        return total


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    @cached_property
    def word_weights(self) -> _WordWeights:
        return _WordWeights(self.weights)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, probability) of each sentence; one empty one at least."""
        weight, out = self.word_weights.__getitem__, []
        for m in _SENTENCE.finditer(text):
            z = self.bias + sum(map(weight, set(_WORD.findall(m.group().lower()))))
            out.append((m.start(), m.end(), 1 / (1 + exp(-min(max(z, -30.0), 30.0)))))
        return out or [(0, 0, 1 / (1 + exp(-self.bias)))]


def noisy_or(probabilities: Iterable[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(np.fromiter(probabilities, float), 1 - 1e-12)).sum()))


class Bags:
    """Texts as numbers: the distinct words of each sentence, 4 bytes a word.

    Features are numbered too; a word's are a row of ``of_word``, -1 where it has
    fewer. Texts themselves are not kept.
    """

    def __init__(self, texts: Iterable[str]) -> None:
        words: dict[str, int] = {}
        self.features: dict[str, int] = {}
        of_word, found = array("i"), array("i")
        sentences, docs = array("q"), array("q")  # words of a sentence, sentences of a document
        for text in texts:
            bag = _SENTENCE.findall(text) or [""]
            for sentence in bag:
                held = set(_WORD.findall(sentence.lower()))
                for word in held:
                    if (number := words.get(word)) is None:
                        number = words[word] = len(words)
                        named = [self.features.setdefault(f, len(self.features)) for f in features(word)]
                        of_word.extend(named + [-1] * (len(PREFIXES) + 1 - len(named)))
                    found.append(number)
                sentences.append(len(held))
            docs.append(len(bag))
        self.of_word = np.frombuffer(of_word, np.int32).reshape(-1, len(PREFIXES) + 1)
        self.words = np.frombuffer(found, np.int32)
        self.sentence_ends = np.cumsum(np.frombuffer(sentences, np.int64))
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.frombuffer(docs, np.int64))
        self.docs = len(docs)

    def document_counts(self, labels: np.ndarray) -> np.ndarray:
        """For label 0 and 1 how many documents have each feature."""
        counts = np.zeros((2, len(self.features)), np.int64)
        last = np.flatnonzero(np.r_[self.doc[1:] != self.doc[:-1], True][: len(self.doc)])
        begin = 0
        for end, label in zip(self.sentence_ends[last].tolist(), labels, strict=True):
            held = np.unique(self.of_word[self.words[begin:end]])
            counts[int(label), held[held >= 0]] += 1
            begin = end
        return counts

    def hits(self, place: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Which chosen features each sentence has, once each, in blocks of sentences:
        (first sentence, sentence counted from it, place). ``place`` is -1 for others."""
        blocks, begin, first = [], 0, 0
        while first < len(self.doc):
            last = max(first + 1, int(np.searchsorted(self.sentence_ends, begin + BLOCK_WORDS, "right")))
            ends = self.sentence_ends[first:last]
            sentence = np.repeat(np.arange(last - first), np.diff(ends, prepend=begin))
            named = self.of_word[self.words[begin : int(ends[-1])]]
            chosen = np.where(named >= 0, place[named], -1)
            at, column = np.nonzero(chosen >= 0)
            both = np.unique(sentence[at] << 32 | chosen[at, column])
            blocks.append((first, (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)))
            begin, first = int(ends[-1]), last
        return blocks


def chosen_words(bags: Bags, y: np.ndarray) -> list[str]:
    """The features whose share of documents differs most between the labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    b, a = bags.document_counts(y)
    p = (a + b) / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    fits = (a + b >= MIN_DOCS) & (p < 1) & (z >= MIN_Z)
    ranked = sorted((-z[i], f) for f, i in bags.features.items() if fits[i])
    return [word for _, word in ranked[:MAX_WORDS]]


def fit(
    texts: Iterable[str], labels: Sequence[int], class_weight: Sequence[float], ridge: float = RIDGE
) -> Model:
    """Maximum likelihood of the noisy-or by Adam, with words chosen by how much
    more often documents of one label have them.

    Texts are read once, one at a time; sentences are worked on in blocks.
    """
    bags, y = Bags(texts), np.asarray(labels, float)
    weight = np.where(y == 1, class_weight[1], class_weight[0])
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        share = float(np.average(y, weights=weight)) if len(y) else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))))
    words = chosen_words(bags, y)
    place = np.full(max(1, len(bags.features)), -1, np.int32)
    place[[bags.features[word] for word in words]] = np.arange(len(words))
    blocks = bags.hits(place)

    theta = np.zeros(len(words) + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        p = np.full(len(bags.doc), theta[-1])
        for begin, row, col in blocks:
            held = np.bincount(row, theta[col])
            p[begin : begin + len(held)] += held
        p = 1 / (1 + np.exp(-np.clip(p, -30, 30)))
        clean = np.bincount(bags.doc, np.log1p(-p), bags.docs)  # log of 1 - P
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        slope = weight * np.where(y == 1, -np.exp(clean) / toxic, 1.0)
        dz = slope[bags.doc] * p
        grad = np.append(np.zeros(len(words)), dz.sum())
        for begin, row, col in blocks:
            grad[:-1] += np.bincount(col, dz[begin + row], len(words))
        grad /= total
        grad[:-1] += ridge * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return Model(float(theta[-1]), dict(zip(words, map(float, theta[:-1]), strict=True)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = PER_LABEL,
    max_chars: int = MAX_CHARS,
) -> Model:
    """Fit on documents whose ids ``labels`` (doc_id, toxic) has."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1)
    )
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id", F.lit(7))
    picked = [
        known.filter(F.col("toxic") == t).orderBy(order, "id").limit(per_label) for t in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_label rows
    read = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = read.join(sample, F.col("doc_id") == F.col("id")).select(
        "id", F.col("text").alias("text"), F.col("toxic").cast("int").alias("toxic")
    )
    used = {t: max(1, min(per_label, share.get(t, 0))) for t in (0, 1)}
    weight = [share.get(t, 0) / used[t] for t in (0, 1)]

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[int] = []

        def texts() -> Iterator[str]:
            for batch in batches:
                known.extend(batch.column("toxic").to_pylist())
                for text in batch.column("text"):
                    yield text.as_py() or ""

        model = fit(texts(), known, weight)
        names = [None, *model.weights]
        values = pa.array([model.bias, *model.weights.values()])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), values], names=["word", "weight"])

    one_task = rows.repartition(1).sortWithinPartitions("id", "text")
    fitted = one_task.mapInArrow(fit_sample, "word string, weight double").collect()
    bias = [r["weight"] for r in fitted if r["word"] is None]
    return Model(bias[0] if bias else -30.0, {r["word"]: r["weight"] for r in fitted if r["word"] is not None})


def scored(text: Column, model: Model, offending: float = OFFENDING) -> Column:
    """A struct: the document's score and its offending sentences, as ``SCORED``."""

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        scores, spans = [], []
        for t in texts:
            found = model.sentences(t or "")
            scores.append(noisy_or(p for _, _, p in found))
            spans.append([{"begin": b, "end": e, "score": p} for b, e, p in found if p >= offending])
        return pd.DataFrame({"score": scores, "sentences": spans})

    return score(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document's columns), ``score`` and the offending ``sentences``."""
    judged = docs.select(whole_row(docs).alias("row"), scored(F.col("text"), model).alias("found"))
    return judged.select("row", "found.score", "found.sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, columns unchanged."""
    model = train(docs, labels)
    return score_documents(docs, model).filter(F.col("score") < threshold).select("row.*")
