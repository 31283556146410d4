"""Toxicity by multiple-instance learning: a text is a bag of sentences.

A sentence's probability is a logistic function of the words and word beginnings in it; a text's is their noisy-or,
``1 - prod(1 - p_s)``, and only the label of the text is known in training. The gradient of the text's loss thus
goes to the sentences that explain it. Sentences with a probability of at least ``LOCATE`` are the offending ones.

Fitted on a bounded sample of labelled rows (at most ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other ones, the
first by hash of the id, and of each kind at most ``MAX_BYTES`` of whole texts); its vocabulary are the ``VOCABULARY`` features that tell the labels apart best. Scoring
covers every row and whole texts, and reads nothing but the text.

Defined results: a null or empty text has no sentence and scores 0; null labels are left out of training; of
several labels of an id the largest counts; without labelled rows of both kinds every score is 0; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import table, text_of, tidy

MAX_POSITIVE, MAX_NEGATIVE, VOCABULARY, MIN_TEXTS = 2_500, 5_000, 2_048, 4
MAX_BYTES = 64_000_000
PREFIXES, CACHE_WORDS = (3, 4, 5, 6), 300_000
STEPS, L2, RATE = 400, 2e-4, 0.1
PREDICT, LOCATE = 0.7, 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case in which every character keeps its place: one whose lower case is longer stays as it is."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class _Hits(dict):
    """word -> its features that have a weight; starts afresh when full."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.weights)
        return found


class NoisyOr:
    """Feature weights and a bias; ``sentences`` gives (start, end, probability) of each sentence with a known word."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -20.0):
        self.weights, self.bias, self.hits = weights or {}, bias, None

    def fit(self, texts: list[str], labels: list[int]) -> "NoisyOr":
        y = np.asarray(labels, float)
        if not (y.any() and (1 - y).any()):
            return self
        # no bag is kept: features of toxic texts are counted first, then, for the frequent ones, all texts
        toxic_with: Counter = Counter()
        for t, label in zip(texts, labels):
            if label:
                toxic_with.update({f for w in set(_WORD.findall(lowered(t))) for f in features(w)})
        toxic_with = Counter({f: n for f, n in toxic_with.items() if n >= MIN_TEXTS})
        with_word: Counter = Counter()
        for t in texts:
            with_word.update({f for w in set(_WORD.findall(lowered(t))) for f in features(w) if f in toxic_with})
        share = y.mean()

        def telling(w):  # chi-square of word and label, signed
            n, k = with_word[w], toxic_with[w]
            return (k - n * share) ** 2 / (n * share * (1 - share))

        words = sorted(with_word, key=lambda w: (-telling(w), w))[:VOCABULARY]
        index = {w: i for i, w in enumerate(words)}
        row, col, owner = [], [], []
        for b, t in enumerate(texts):
            for s in _SENTENCE.findall(lowered(t)):
                known = sorted({index[f] for w in _WORD.findall(s) for f in features(w) if f in index})
                row += [len(owner)] * len(known)
                col += known
                owner.append(b)
        row, col, owner = np.array(row, int), np.array(col, int), np.array(owner, int)
        balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        w, b = np.zeros(len(words)), -4.0
        m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        for step in range(1, STEPS + 1):
            z = b + np.bincount(row, w[col], len(owner))
            total = np.bincount(owner, np.logaddexp(0, z), len(y))  # -log of the probability that no sentence is toxic
            slope = balance * np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / len(y)
            by_sentence = slope[owner] / (1 + np.exp(-z))
            g = np.append(np.bincount(col, by_sentence[row], len(w)) + L2 * w, by_sentence.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights, self.bias = {x: float(a) for x, a in zip(words, w) if abs(a) > 1e-3}, float(b)
        return self

    def sentences(self, text: str):
        lower = lowered(text)
        if self.hits is None:
            self.hits = _Hits(self.weights)
        for m in _SENTENCE.finditer(lower):
            found = {f for w in _WORD.findall(m.group()) for f in self.hits[w]}
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            yield m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -500 else 0.0

    def score(self, text: str):
        """The text's probability, and its offending sentences."""
        clean, found = 1.0, []
        for a, b, p in self.sentences(text):
            clean *= 1 - p
            if p >= LOCATE:
                found.append((a, b, float(p)))
        return float(1 - clean), found


class ToxicityModel:
    def __init__(self, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES):
        self.limits, self.max_bytes, self.model = {1: max_positive, 0: max_negative}, max_bytes, NoisyOr()

    def fit(self, docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic") -> "ToxicityModel":
        """``labels`` are the rows to learn from (hold others out before)."""
        known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label).alias("y"))
        first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in self.limits.items()]
        chosen = F.broadcast(first[0].unionByName(first[1]))  # at most max_positive + max_negative ids
        texts = docs.select(F.col(id_column).alias("id"), text_of(text).alias("t"))
        sizes = texts.join(chosen, "id").groupBy("id", "y").agg(F.max(F.octet_length("t")).alias("bytes"), F.min(F.xxhash64("t")).alias("h")).orderBy(F.xxhash64("id"), "id").collect()
        left, fit = dict.fromkeys(self.limits, self.max_bytes), []
        for r in sizes:  # a text that doesn't fit any more is left out of the sample, whole
            if r["bytes"] <= left[r["y"]]:
                left[r["y"]] -= r["bytes"]
                fit.append((r["id"], r["h"], int(r["y"])))
        kind = docs.schema[id_column].dataType.simpleString()
        wanted = F.broadcast(docs.sparkSession.createDataFrame(fit, f"id {kind}, h long, y int"))
        rows = texts.withColumn("h", F.xxhash64("t")).join(wanted, ["id", "h"]).dropDuplicates(["id"]).select("id", "t", "y").toPandas().sort_values("id")
        self.model.fit(rows["t"].tolist(), rows["y"].astype(int).tolist())
        return self

    def score(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """``id_column``, score, sentences: the offending ones as (start, end, probability)."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

        def run(batches):
            for batch in batches:
                scores, found = [], []
                for t in batch.column(1).to_pylist():
                    score, bad = shared.value.score(t) if t else (0.0, [])
                    scores.append(score)
                    found.append([{"start": a, "end": b, "p": p} for a, b, p in bad])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["id", "score", "sentences"])

        plain = docs.select(F.col(id_column).alias("id"), text_of(text).alias("t"))
        key = docs.schema[id_column].dataType.simpleString()
        return plain.mapInArrow(tidy(run), f"id {key}, score double, sentences array<struct<start:long,end:long,p:double>>").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ToxicityModel().fit(docs, labels.where(~held_out()))
    scored = model.score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"),
        F.transform("sentences", lambda s: s["start"]).alias("offending_starts"),
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES = {}
