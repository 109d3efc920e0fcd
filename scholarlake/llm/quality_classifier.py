"""Operator 4: document quality from a linear-chain conditional random field over lines.

Every line has measures (length, word length, capitals, symbols, repetition ...), its
own and those of both neighbours, each cut into bins; a chain of two labels (bad, good)
runs over a document's lines. It is fitted by gradient ascent on the conditional
likelihood of a bounded, hash-ordered sample of labelled documents (in rows and in
characters) whose lines carry their document's label. A document's quality is the length-weighted mean of its lines'
forward-backward marginals, calibrated by a logistic curve fitted on the same sample.

Defined results: null and empty texts are one empty line and are scored like any other;
without labels of both kinds every score is the smoothed share of label 1; repeated
rows are scored each; a null doc_id is scored, held_out reads false; only doc_id and
text are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, read_table
from .samples import labelled_sample

SYMBOLS = "#*$%&|<>@^~={}[]\\_+"
BINS = 8
#: No letter, digit or space has a code point from here on.
LAST_LETTER = 0x32400


def _classes() -> np.ndarray:
    """Bits by code point: 1 letter, 2 upper, 4 digit, 8 space, 16 symbol, 32 end mark, 64 other sign."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(LAST_LETTER):
        c = chr(i)
        out[i] = 1 * c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() + 8 * c.isspace() + 16 * (c in SYMBOLS) + 32 * (c in "!?")
    out[out == 0] = 64
    return out


CLASSES = _classes()
MEASURES = 12


def line_measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures by line, characters by line, lines by text) of whole texts."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10)
    starts = np.r_[0, ends[:-1] + 1]
    kinds = CLASSES[points]
    chars = (ends - starts).astype(float)
    sums = [np.add.reduceat((kinds >> bit) & 1, starts, dtype=np.int64) for bit in range(7)]
    letters, upper, digits, spaces, symbols, marks, signs = sums
    spaces = spaces - 1  # the line feed itself
    unique, words, again = np.empty(len(chars)), np.empty(len(chars)), np.empty(len(chars))
    at = 0
    for doc in lines:
        seen: set[str] = set()
        for line in doc:
            w = line.split()
            words[at], unique[at] = len(w), len(set(w))
            again[at] = bool(w) and line in seen
            seen.add(line)
            at += 1
    solid = np.maximum(chars - spaces, 1)
    share = lambda x: np.log1p(100 * x / solid)
    columns = [
        np.log1p(chars), np.log1p(words), solid / np.maximum(words, 1), share(upper), share(digits), share(symbols), share(marks),
        share(signs), share(letters), unique / np.maximum(words, 1), again, np.minimum(chars, 1),
    ]
    return np.stack(columns, 1), chars, counts


class LineField:
    """The chain: weights by measure, bin and neighbour; transitions; calibration."""

    def __init__(self, edges: np.ndarray, prior: float):
        self.edges, self.prior = edges, prior
        self.weights = np.zeros(3 * MEASURES * (BINS + 1) + 1)
        self.weights[-1] = np.log(prior / (1 - prior))
        self.pull = np.array([1.0, 1.0])  # for staying bad, staying good
        self.curve = (0.0, 1.0)

    def features(self, measures: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Indices of the active weights of every line; beyond the ends of a text there is bin ``BINS``."""
        bins = np.stack([np.searchsorted(self.edges[m], measures[:, m], side="right") for m in range(MEASURES)], 1)
        first = np.cumsum(counts) - counts
        last = first + counts - 1
        before, after = np.roll(bins, 1, 0), np.roll(bins, -1, 0)
        before[first], after[last] = BINS, BINS
        offset = np.arange(MEASURES) * (BINS + 1)
        size = MEASURES * (BINS + 1)
        return np.concatenate([bins + offset, before + offset + size, after + offset + 2 * size], 1)

    def marginals(self, unary: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) by line, P(bad, bad) and P(good, good) by line with its predecessor); all texts in lockstep."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        steps = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(steps), side="left")
        bad, good = self.pull
        ahead = np.zeros(len(unary))  # log-odds of good from the left, this line included
        for i in range(steps):
            at = first[: active[i]] + i
            if i == 0:
                ahead[at] = unary[at]
            else:
                x = ahead[at - 1]
                ahead[at] = unary[at] + np.logaddexp(0, x + good) - np.logaddexp(bad, x)
        back = np.zeros(len(unary))  # log-odds of good from the right, this line excluded
        for i in range(steps - 2, -1, -1):
            at = first[: active[i + 1]] + i
            y = back[at + 1] + unary[at + 1]
            back[at] = np.logaddexp(0, y + good) - np.logaddexp(bad, y)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
        both_bad, both_good = np.zeros(len(unary)), np.zeros(len(unary))
        inner = np.ones(len(unary), bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(inner)
        x, y = ahead[at - 1], back[at] + unary[at]
        parts = np.stack([np.full(len(at), bad), y, x, x + y + good], 1)  # bad-bad, bad-good, good-bad, good-good
        parts = np.exp(parts - parts.max(1, keepdims=True))
        parts /= parts.sum(1, keepdims=True)
        both_bad[at], both_good[at] = parts[:, 0], parts[:, 3]
        return p, both_bad, both_good

    def quality(self, texts: list[str]) -> np.ndarray:
        measures, chars, counts = line_measures(texts)
        unary = self.weights[self.features(measures, counts)].sum(1) + self.weights[-1]
        p, _, _ = self.marginals(unary, counts)
        weight = np.maximum(chars, 1)
        first = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        a, b = self.curve
        q = np.clip(self.quality(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(a + b * np.log(q / (1 - q)))))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.value)


def train(texts: list[str], labels: np.ndarray, steps: int = 150, decay: float = 2e-4):
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Constant(float(prior))
    measures, _, counts = line_measures(texts)
    model = LineField(np.stack([np.quantile(measures[:, m], np.linspace(0, 1, BINS + 1)[1:-1]) for m in range(MEASURES)]), float(prior))
    active = model.features(measures, counts)
    y = np.repeat(labels, counts).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    weight = np.repeat(1 / counts, counts)  # a document counts once, however many lines it has
    total = len(counts)
    m1 = m2 = np.zeros(len(model.weights) + 2)
    for step in range(1, steps + 1):  # Adam
        unary = model.weights[active].sum(1) + model.weights[-1]
        p, bad, good = model.marginals(unary, counts)
        error = (y - p) * weight
        gradient = np.bincount(active.ravel(), np.repeat(error, active.shape[1]), len(model.weights)) / total
        gradient[-1] = error.sum() / total
        pull = np.array([((1 - y) - bad)[inner] @ weight[inner], (y - good)[inner] @ weight[inner]]) / total
        gradient = np.r_[gradient - decay * model.weights, pull - 0.01 * model.pull]
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.99 * m2 + 0.01 * gradient**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[:-2]
        model.pull = model.pull + move[-2:]
    q = np.clip(model.quality(texts), 1e-6, 1 - 1e-6)
    x, a, b = np.log(q / (1 - q)), 0.0, 1.0
    for _ in range(30):  # Newton's method for the calibration, slightly damped towards the identity
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(labels - p).sum() - a, ((labels - p) * x).sum() - (b - 1)])
        w = p * (1 - p)
        h = np.array([[w.sum() + 1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    model.curve = (float(a), float(b))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 24_000_000, line_chars: int = 50):
    """Learn from at most ``sample_rows`` rows of ``labels`` (doc_id, quality).

    Where their texts are of more than ``sample_chars`` characters, each line counted as
    ``line_chars`` more, the longest stay out of the fit; they are scored like any other.
    """
    sample = labelled_sample(docs, labels, "quality", sample_rows)
    size = F.length("text").cast("long") + line_chars * (F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    sizes = sample.select(F.col("doc_id").alias("_id"), size.alias("_size"))  # ``sample_rows`` pairs of numbers at most
    within = sizes.withColumn("_sum", F.sum("_size").over(Window.orderBy("_size", "_id"))).filter(F.col("_sum") <= sample_chars)
    rows = sample.join(F.broadcast(within), F.col("doc_id") == F.col("_id"), "left_semi").orderBy("doc_id").collect()
    if not rows:
        return Constant(0.5)
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, model, predicted_from: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                score = held.value.score([t or "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": score, "predicted": (score >= predicted_from).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def op4_quality_classifier(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_remainder("doc_id", 5) != 0))
    return score_quality(docs, model).select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
