"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Memo, crc_mod, filter_texts, map_texts, parts, prepare

#: Hash space of the features; bound of the labelled rows that training reads.
BITS, TRAIN_ROWS = 18, 6000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.dtype([("at", "<i4"), ("value", "<f4")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashed unigrams and bigrams of word tokens; words and runs of marks are tokens.

    A token followed by itself counts as the n-gram "repeat" besides its bigram.
    """

    def __init__(self, bits: int = BITS, kept: int = 150_000) -> None:
        self.bits = bits
        self.known = Memo(lambda word: np.array([zlib.crc32(t.encode()) + 1 for t in self.tokens(word)], np.uint64), kept)

    @staticmethod
    def tokens(word: str) -> list[str]:
        """Tokens of a blank-free word, their case reduced to lower, Capital or UPPER."""
        return [p.lower() if p.islower() or len(p) < 2 else ("^" if p.isupper() else "'") + p.lower() for p in _TOKEN.findall(word)]

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers below 2 ** bits and their values: root counts scaled to length 1."""
        known = self.known
        hashes = [known[w] for w in text.split()]
        if not hashes:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        h = np.concatenate(hashes)
        again = np.zeros(int((h[:-1] == h[1:]).sum()), np.uint64)
        mixed = np.concatenate([h, (h[:-1] * _ODD) ^ h[1:], again]) * _ODD
        at, count = np.unique((mixed >> np.uint64(64 - self.bits)).astype(np.int64), return_counts=True)
        return at, np.sqrt(count / max(1, count.sum())).astype(np.float32)


def dot(weights: np.ndarray, bias: float, features: tuple[np.ndarray, np.ndarray]) -> float:
    return bias + float(weights[features[0]] @ features[1])


def train_ftrl(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int = BITS, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader updates, one row at a time.

    A row's feature values have length 1, so that long texts weigh as much as short ones.
    The bias is one more feature, of value 1.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        return w

    ready = []
    for (at, value), label in rows:
        ready.append((np.append(at, size), np.append(value, 1.0).astype(np.float64), label))
    for _ in range(epochs):
        for at, value, label in ready:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size + 1))
    return every[:-1].astype(np.float32), float(every[-1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fifth, in the order of a hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    usable = usable.groupBy("id").agg(F.min("label").alias("label")).where(crc_mod("id", 5) != 0)
    picked = usable.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "id")


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAIN_ROWS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows; features are hashed by the executors.

    The sample is at most ``rows`` labelled ids (the bound of all that is broadcast and
    collected: a row has at most 2 ** bits features), a document that occurs several times
    once per different text.  Without usable labels every score is 0.5.  The usual edge
    cases; labels that are null or neither 0 nor 1 are left out, and of several labels of an
    id the least counts.
    """
    prepare(docs.sparkSession)
    sample = training_rows(docs, labels, rows, id_col, text_col, label_col).select("turn", "id", "label", "text")

    def hashed(batches):
        hasher = Hasher(bits)
        for b in batches:
            for part, texts in parts(b, 3):
                got = [np.rec.fromarrays(hasher.features(t), _PAIR).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(got, pa.binary())], ["turn", "id", "label", "features"])

    id_type = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(hashed, f"turn long, id {id_type}, label int, features binary").toPandas().drop_duplicates().sort_values(["turn", "id", "features"])
    pairs = [np.frombuffer(f, _PAIR) for f in got["features"]]
    return train_ftrl([((p["at"].astype(np.int64), p["value"]), int(y)) for p, y in zip(pairs, got["label"], strict=True)], bits)


def score_quality(
    docs: DataFrame,
    model: tuple[np.ndarray, float],
    threshold: float = 0.3,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """held_out, score and predicted (1 if score >= threshold) of every whole text, as sparse dot products.

    The usual edge cases; an empty text is scored by the bias alone, and a null id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, bias = sent.value
        hasher = Hasher(bits)

        def apply(texts: list[str]) -> dict[str, list]:
            out = []
            for t in texts:
                s = dot(weights, bias, hasher.features(t))
                out.append(1.0 / (1.0 + math.exp(-min(max(s, -35.0), 35.0))))
            return {"score": out}

        return apply

    scored = map_texts(docs, make, "score double", id_col, text_col)
    return scored.select(id_col, F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose text is predicted 1, in one pass without a join.

    The usual edge cases; an empty text is judged by the bias alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    least = math.log(threshold / (1 - threshold))

    def make():
        weights, bias = sent.value
        hasher = Hasher(bits)
        return lambda texts: [dot(weights, bias, hasher.features(t)) >= least for t in texts]

    return filter_texts(docs, make, text_col)
