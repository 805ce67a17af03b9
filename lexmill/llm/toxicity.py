"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is the logistic of a sum of weights over its features (lower-case words and their prefixes of four
and five letters). A document's score is the noisy-or of its sentences' scores, 1 - prod(1 - p), in which the sum of
-log(1 - p) is corrected for the number of sentences: what a sentence of clean documents adds on average, while under
the threshold, is taken off for each sentence, down to what the highest sentence gives alone. So a clean document is not
toxic by its length. Weights are trained from document labels through the noisy-or, at a fixed bias; the sentences that
score at least the threshold are located by code-point offsets.

The classifier is fitted on the driver on a bounded sample of labelled rows: the first `MAX_TOXIC` toxic and `MAX_CLEAN`
clean documents by hash of their id, among texts of at most `MAX_CHARS` characters, so that the sample's size is bounded
too. Every document is scored, over its whole text, in time and memory that grow with the text alone. Null and empty texts
have no sentence and score 0. If doc_ids repeat in labels, one toxic row makes the document toxic; if they repeat among
documents, each row is scored and the sample takes the smallest text. Without labels of both kinds every sentence scores
the share of toxic labels (0 without labels). Columns other than those named are neither read nor returned. An empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2000, 100_000
MAX_FEATURES = 3000
MIN_DOCS = 3
EPOCHS = 200
#: Logit of a sentence without evidence, fixed and low.
BIAS = -10.0
#: Evidence, in share of the sample's documents, that a feature needs before it gets a weight.
LEAST_GAIN = 3e-4
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> tuple[str, ...]:
    """The features of one lower-case word; prefixes are marked so that they differ from words."""
    return (word,) if len(word) < 6 else (word, word[:4] + "*", word[:5] + "*")


def _sentences(text: str) -> list[set[str]]:
    return [{f for w in _WORD.findall(m[0]) for f in features_of(w)} for m in _SENTENCE.finditer(text.lower())]


class Model:
    """Weights by feature, the bias of a sentence, and what each sentence adds to -log(1 - score) without evidence."""

    def __init__(self, weights: dict[str, float], bias: float, rate: float = 0.0) -> None:
        self.weights, self.bias, self.rate = weights, bias, rate
        self._cache: dict[str, float] = {}

    def _logit(self, z: float) -> float:
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, offending sentences as start, end, score)."""
        if not text:
            return 0.0, []
        get, known = self.weights.get, self._cache
        if len(known) > 1_000_000:
            known.clear()
        low = text.lower()
        keep, places, n, total, least = 0.0, [], 0, 0, 0.0
        base = self._logit(self.bias)
        quiet = np.log1p(-base)
        for m in _SENTENCE.finditer(low):
            n += 1
            total += 1
            hits = None
            for w in _WORD.findall(m[0]):
                if (near := known.get(w)) is None:
                    near = known[w] = tuple(f for f in features_of(w) if get(f))
                if near:
                    hits = (hits or set()).union(near)
            if hits:
                p = min(self._logit(self.bias + sum(get(f) for f in sorted(hits))), 1 - 1e-12)
                own = np.log1p(-p)
                keep += own
                least = min(least, own)
                n -= 1
                if p >= THRESHOLD:
                    places.append((m.start(), m.end(), float(p)))
        if len(low) != len(text):  # a letter whose lower case is longer: offsets are those of the source, sentence by sentence
            source = [m.span() for m in _SENTENCE.finditer(text)]
            order = {m.start(): i for i, m in enumerate(_SENTENCE.finditer(low))}
            places = [(*source[order[a]], p) for a, _, p in places]
        keep += n * quiet
        if self.rate:
            keep = min(keep + total * self.rate, least, quiet if n else 0.0)
        return float(min(1.0, max(0.0, -np.expm1(keep)))), places


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Noisy-or maximum likelihood by proximal AdaGrad. Weights are not negative: a feature is evidence or none."""
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    bags = [_sentences(t or "") for t in texts]
    in_toxic, in_clean = Counter(), Counter()
    for bag, label in zip(bags, toxic, strict=True):
        (in_toxic if label else in_clean).update(set().union(*bag) if bag else ())
    n1, n0 = y.sum(), len(y) - y.sum()

    def gain(f: str) -> float:
        a, b = in_toxic[f] / n1, in_clean[f] / n0
        return abs(a - b) / np.sqrt(a + b)

    frequent = [f for f in in_toxic.keys() | in_clean.keys() if in_toxic[f] + in_clean[f] >= MIN_DOCS]
    chosen = sorted(frequent, key=lambda f: (-gain(f), f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    # Sentences with the same features in the same document, mostly none, are one weighted instance.
    feature, instance, owner, times = [], [], [], []
    for d, bag in enumerate(bags):
        for ids, k in Counter(tuple(sorted(index[f] for f in s if f in index)) for s in bag).items():
            feature += ids
            instance += [len(owner)] * len(ids)
            owner.append(d)
            times.append(k)
    feature, instance, owner, times = (np.array(x, np.int64) for x in (feature, instance, owner, times))
    w, grad_w = np.zeros(len(chosen)), np.full(len(chosen), 1e-6)
    for _ in range(EPOCHS):
        z = np.minimum(BIAS + np.bincount(instance, w[feature], len(owner)), 30)
        p = 1 / (1 + np.exp(-z))
        P = np.clip(-np.expm1(np.bincount(owner, times * np.log1p(-p), len(y))), 1e-12, 1.0)
        push = np.where(y == 1, (1 - P) / P, -1.0)
        g = np.bincount(feature, (times * p * push[owner])[instance], len(chosen)) / len(y) - LEAST_GAIN
        grad_w += g**2
        w = np.maximum(0, w + 0.7 * g / np.sqrt(grad_w))
    w = np.where(w > 0.05, w, 0.0)
    p = 1 / (1 + np.exp(-np.minimum(BIAS + np.bincount(instance, w[feature], len(owner)), 30)))
    clean = (y[owner] == 0) & (p < THRESHOLD)
    rate = float(np.average(-np.log1p(-p[clean]), weights=times[clean])) if clean.any() else 0.0
    return Model({f: float(v) for f, v in zip(chosen, w, strict=True) if v}, BIAS, rate)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.length(F.coalesce("text", F.lit(""))) <= MAX_CHARS).select("doc_id", "text")
    known = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id"))
    first = lambda label, most: known.filter(F.col("toxic") == label).orderBy("place", "doc_id").limit(most)
    sample = F.broadcast(first(1, MAX_TOXIC).unionByName(first(0, MAX_CLEAN)))
    rows = short.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


_SCHEMA = "held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, score, predicted, offending (sentences)."""
    weights, bias, rate = model.weights, model.bias, model.rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias, rate)
        places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            rows = [own.score(t.as_py()) for t in batch.column(2)]
            score = [s for s, _ in rows]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in spots] for _, spots in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(found, places)],
                names=["doc_id", "held_out", "score", "predicted", "offending"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
