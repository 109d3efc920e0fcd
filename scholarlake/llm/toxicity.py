"""Operator 9: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of toxic words and word beginnings is learned from labelled text as tokens
that are far more frequent in toxic documents, and joined with a short given list. Dense
features of a whole text (lexicon densities, nearness of hits to second-person words,
capitals, punctuation, obfuscation) go to Spark's gradient-boosted trees, whose margin
an isotonic regression turns into a probability. Lexicon, trees and calibration are
fitted on disjoint parts of a bounded, hash-ordered sample of labelled documents.

Defined results: null and empty texts have zero features and are scored like any other;
without labels of both kinds every score is the smoothed share of label 1; repeated rows
are scored each; a null doc_id is scored, held_out reads false; only doc_id and text are
read for a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, materialize, read_table
from .quality_classifier import CLASSES
from .samples import labelled_sample

#: Given words; the rest of the lexicon is learned.
BASE_LEXICON = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile".split())
SECOND_PERSON = frozenset("you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
#: Signs written for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "_": "", "-": ""})
STRIP = str.maketrans(dict.fromkeys(".,;:!?\"'()[]{}«»¿¡…", " "))
#: Begins where a run of letters does and never steps back, so that it is linear in a run's length.
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*]++[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
STEM, LEAST_STEM = (5, 4), 4
NEAR = 5
FEATURES = 15


def tokens_of(text: str) -> list[str]:
    return text.lower().translate(STRIP).split()


def features(text: str, words: frozenset, stems: frozenset) -> list[float]:
    tokens = tokens_of(text)
    n = max(len(tokens), 1)
    hits = [i for i, w in enumerate(tokens) if w in words]
    stem_hits = [i for i, w in enumerate(tokens) if w[:5] in stems or w[:4] in stems]
    masked = [w.lower().translate(DISGUISE) for w in MASKED.findall(text)]
    hidden = sum(w in words or w[:5] in stems for w in masked)
    both = hits + stem_hits
    you = np.array([i for i, w in enumerate(tokens) if w in SECOND_PERSON])
    near = 0
    if len(you) and both:
        at = np.asarray(both)
        place = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(place, len(you) - 1)] - at), np.abs(you[np.maximum(place - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    chars = max(len(text), 1)
    raw = text.split()
    kinds = CLASSES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    capitals, letters = np.count_nonzero(kinds & 2), max(np.count_nonzero(kinds & 1), 1)
    stretched = sum(1 for _ in STRETCHED.finditer(text))
    return [
        100 * len(hits) / n, np.log1p(len(hits)), len({tokens[i] for i in hits}),
        100 * len(stem_hits) / n, np.log1p(len(stem_hits)), len({tokens[i][:5] for i in stem_hits}),
        near, 100 * len(you) / n,
        100 * sum(map(str.isupper, raw)) / n, 100 * capitals / letters,
        100 * (text.count("!") + text.count("?")) / chars, 100 * (text.count(".") + text.count(",")) / chars,
        100 * (len(masked) + stretched) / n, hidden, np.log1p(len(tokens)),
    ]


def learn_lexicon(sample: DataFrame, most: int = 4000, odds: float = 2.5, least: int = 3, purity: float = 0.6) -> tuple[frozenset, frozenset]:
    """(words, stems): tokens at least exp(odds) times as frequent in toxic documents; at most ``most``."""
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return BASE_LEXICON, frozenset()
    clear = F.translate(F.lower("text"), ".,;:!?\"'()[]{}«»¿¡…", " " * 20)
    words = F.array_distinct(F.split(clear, r"\s+"))
    tagged = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), *[F.transform(words, lambda w, k=k: F.concat(F.lit("s"), F.substring(w, 1, k))) for k in STEM]))
    counts = sample.select("label", F.explode(tagged).alias("token")).groupBy("token").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    enough = max(least, toxic // 200)
    found = counts.filter((F.col("t") >= enough) & (ratio >= odds) & (F.col("t") >= purity * (F.col("t") + F.col("c"))) & (F.length("token") > LEAST_STEM)).orderBy(F.desc(ratio), "token").limit(most).collect()
    words_ = {r["token"][1:] for r in found if r["token"][0] == "w"}
    stems = {r["token"][1:] for r in found if r["token"][0] == "s"}
    return frozenset(words_) | BASE_LEXICON, frozenset(stems)


def with_features(rows: DataFrame, words: frozenset, stems: frozenset) -> DataFrame:
    """doc_id, whatever other columns but text, and ``features`` as an array of doubles."""
    held = rows.sparkSession.sparkContext.broadcast((words, stems))
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, stems = held.value
        for batch in batches:
            out = batch[[f for f in batch.columns if f != "text"]].copy()
            out["dense"] = [features(t or "", words, stems) for t in batch["text"]]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", dense array<double>"
    return rows.mapInPandas(run, schema).withColumn("features", array_to_vector("dense")).drop("dense")


class ToxicityModel:
    def __init__(self, words, stems, trees, curve, prior):
        self.words, self.stems, self.trees, self.curve, self.prior = words, stems, trees, curve, prior

    def score(self, docs: DataFrame, predicted_from: float = 0.3) -> DataFrame:
        """(doc_id, score, predicted) of whole texts."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if self.trees is None:
            scored = rows.select("doc_id", F.lit(self.prior).alias("score"))
        else:
            margin = margins(self.trees, with_features(rows, self.words, self.stems))
            scored = self.curve.transform(margin).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))
        return scored.select("doc_id", "score", (F.col("score") >= predicted_from).cast("int").alias("predicted"))


def margins(trees, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, rounds: int = 20, depth: int = 3) -> ToxicityModel:
    """Learn from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10))
    stats = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    prior = (stats["t"] + 1) / (stats["n"] + 2)
    words, stems = learn_lexicon(sample.filter(part < 5))
    rows = materialize(with_features(sample.select("doc_id", F.col("label").cast("double").alias("label"), "text"), words, stems), "toxic-features").coalesce(4).cache()  # features of ``sample_rows`` rows at most
    rest = rows.filter(part >= 5)
    for_trees, for_curve = rest.filter(part < 8), rest.filter(part >= 8)
    try:
        if for_trees.select("label").distinct().count() < 2 or for_curve.select("label").distinct().count() < 2:
            return ToxicityModel(words, stems, None, None, float(prior))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=11, maxBins=32).fit(for_trees)
        curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins(trees, for_curve))
        return ToxicityModel(words, stems, trees, curve, float(prior))
    finally:
        rows.unpersist()


def op9_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_remainder("doc_id", 4) != 2))
    return model.score(docs).select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
