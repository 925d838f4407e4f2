"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import and_columns, small_batches

#: Hash buckets of features.
BUCKETS = 1 << 20
#: Labelled rows that the fit uses, about: more are sampled down by the hash of doc_id, so training fits one task. Each label
#: may fill half of them; what the other leaves free it may use too.
TRAIN_ROWS = 12_000
#: Passes over them, and the weight of a toxic row, of which there are few.
PASSES, TOXIC_WEIGHT = 8, 5.0
#: Words whose hashes a Python worker remembers.
WORDS_KEPT = 100_000
_WORD = re.compile(r"[^\W\d_]+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


_hashes = WordHashes()


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words, word pairs, and pairs with one word between; none if it has no word."""
    words = _WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    first, second, third = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    mixed = np.concatenate([h * first, h[:-1] * second ^ h[1:] * first, h[:-2] * third ^ h[2:] * second])
    return np.unique((mixed ^ mixed >> np.uint64(29)) * first >> np.uint64(44))


@dataclass
class Ftrl:
    """FTRL-proximal: each coordinate has its own rate, and l1 keeps rare coordinates at zero."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.02

    def fit(self, rows: list[tuple[np.ndarray, int]], passes: int = PASSES, toxic_weight: float = TOXIC_WEIGHT) -> np.ndarray:
        """Weights of all buckets and, last, the bias, from (buckets, label) in the given order."""
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for _ in range(passes):
            for at, label in rows:
                x = np.append(at, BUCKETS).astype(np.int64)
                w = self.weights(z[x], n[x])
                g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (toxic_weight if label else 1.0)
                rate = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / self.alpha
                z[x] += g - rate * w
                n[x] += g * g
        return self.weights(z, n)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """Nonzero weights (bucket, weight), the bias under BUCKETS, of docs (doc_id, text) by labels (doc_id, toxic).

    About train_rows labelled rows of docs are used, chosen by a hash of their doc_id, of each label about half if there are
    so many; a toxic row's weight makes up for the label's share in the sample. toxic counts if any label row says so, null
    labels and ids are left out, equal rows of docs count each. Whole texts count, however long. Without both labels, or
    with an empty table: none.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.count("*").alias("copies"))
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.sum("copies").alias("n")).collect()}  # two labels
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    some_toxic = min(toxic, max(train_rows // 2, train_rows - clean))
    shares = (min(1.0, (train_rows - some_toxic) / max(1, clean)), some_toxic / max(1, toxic))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = labelled.select("doc_id", "toxic").filter(place < F.when(F.col("toxic") == 1, int(shares[1] * (1 << 30))).otherwise(int(shares[0] * (1 << 30))))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(place.alias("place"), "text", "toxic")  # bounded by train_rows
    toxic_weight = TOXIC_WEIGHT * shares[0] / (shares[1] or 1.0)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array([features(t).astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["place", "toxic", "buckets"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [r for frame in batches for r in frame.itertuples(index=False)]
        ordered = [(np.frombuffer(r.buckets, np.uint32), int(r.toxic)) for r in sorted(got, key=lambda r: (r.place, r.buckets))]
        if len({label for _, label in ordered}) == 2:
            w = Ftrl().fit(ordered, toxic_weight=toxic_weight)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"bucket": at, "weight": w[at]})

    hashed = rows.mapInArrow(buckets, "place long, toxic int, buckets binary")
    return hashed.repartition(1).mapInPandas(fit, "bucket long, weight double").toPandas()


def score(docs: DataFrame, weights: pd.DataFrame, threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from threshold on) to docs, which has a text; every other column is kept.

    The whole text counts, however long. A null or empty text has the score of the bias; with no weights every score is 0.5.
    Equal texts have equal scores, an empty table gives an empty table; columns score and predicted are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most BUCKETS + 1 rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(BUCKETS + 1)
        w[shared.value["bucket"].to_numpy(np.int64)] = shared.value["weight"]
        for batch in batches:
            sums = np.array([w[features(t)].sum() + w[BUCKETS] for t in batch.column("text").to_pylist()], float)
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            kept = [c for c in batch.schema.names if c not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(judge, and_columns(docs, "score double, predicted int"))
