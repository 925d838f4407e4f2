"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors, permuted
by their places; a text's vector bundles (adds) those of its n-grams, a language's prototype those of its texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import and_columns, small_batches

#: Components of a vector.
DIMENSIONS = 2048
#: N-grams whose vectors a Python worker remembers: 80 MB of them.
GRAMS_KEPT = 40_000
#: N-grams whose vectors are multiplied at once.
TILE = 4096
#: Languages at most: each is a vector that is collected and broadcast.
MOST_LANGUAGES = 4096
_SPACE = 32
_BITS = 21


def letter_vector(code: int) -> np.ndarray:
    """The random vector of a letter: the same in every process."""
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Letters:
    """Which code points are letters, and n-grams of texts."""

    table: np.ndarray | None = None

    @classmethod
    def grams(cls, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct three-grams of letters and word gaps with their counts; None without a letter."""
        if not text:
            return None
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
        letters = cls.table[codes]
        if not letters.any():
            return None
        codes = np.where(letters, codes, _SPACE)
        codes = codes[np.concatenate(([True], letters[1:] | letters[:-1]))].astype(np.uint64)
        return np.unique(codes[:-2] << np.uint64(2 * _BITS) | codes[1:-1] << np.uint64(_BITS) | codes[2:], return_counts=True)


class GramVectors:
    """Vectors of n-grams from remembered letters' vectors."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        got = self.letters.get(code)
        if got is None:
            if len(self.letters) > 2000:
                self.letters.clear()
            got = self.letters[code] = letter_vector(code)
        return got

    def gram(self, gram: int) -> np.ndarray:
        mask = (1 << _BITS) - 1
        return np.roll(self.letter(gram >> 2 * _BITS), 2) * np.roll(self.letter(gram >> _BITS & mask), 1) * self.letter(gram & mask)


class Bundles(dict):
    """Vectors of texts from remembered vectors of n-grams, which are rows of one array."""

    def __init__(self):
        super().__init__()
        self.vectors = GramVectors()
        self.rows = np.zeros((GRAMS_KEPT, DIMENSIONS), np.int8)

    def __missing__(self, gram: int) -> int:
        at = self[gram] = len(self)
        self.rows[at] = self.vectors.gram(gram)
        return at

    def of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each text, given by its n-grams and their counts, the sum of the n-grams' vectors, each as often as it counts.

        One product of the texts' counts with the vectors of all their n-grams, TILE of these at a time.
        """
        total = np.zeros((len(texts), DIMENSIONS))
        if not texts:
            return total
        grams, where = np.unique(np.concatenate([g for g, _ in texts]), return_inverse=True)
        row, counts = np.repeat(np.arange(len(texts)), [len(g) for g, _ in texts]), np.concatenate([c for _, c in texts])
        order = np.argsort(where, kind="stable")
        row, where, counts = row[order], where[order], counts[order]
        exact = np.float32 if max(c.sum() for _, c in texts) < 1 << 24 else np.float64  # sums of whole numbers in it are exact
        for i in range(0, len(grams), TILE):
            some = grams[i : i + TILE]
            if len(self) + len(some) > GRAMS_KEPT:
                self.clear()
            places = np.fromiter(map(self.__getitem__, some.tolist()), np.int64, len(some))
            a, b = np.searchsorted(where, (i, i + len(some)))
            weights = np.zeros((len(texts), len(some)), exact)
            weights[row[a:b], where[a:b] - i] = counts[a:b]
            total += weights @ self.rows[places].astype(exact)
        return total


def learn(docs: DataFrame) -> pd.DataFrame:
    """Prototypes (lang, vector) from all rows of docs (text, lang) that have a lang and a letter.

    Counts of n-grams are summed over all texts, each partition's first; then every partition of the summed table
    bundles its n-grams' vectors. The prototypes come to the driver: one vector for each language, of which there may be
    MOST_LANGUAGES; more are an error. Whole texts count, equal rows count each; an empty table teaches nothing.
    """
    small_batches(docs.sparkSession)
    if docs.filter("lang IS NOT NULL").select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (found := Letters.grams(text)) is not None:
                    by_lang.setdefault(lang, []).append(found)
            for lang, all_found in by_lang.items():
                grams, where = np.unique(np.concatenate([g for g, _ in all_found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in all_found]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = GramVectors(), {}
        for frame in batches:
            for lang, gram, n in zip(frame["lang"], frame["gram"], frame["n"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(DIMENSIONS)
                sums[lang] += n * vectors.gram(int(gram)).astype(float)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(DIMENSIONS), "value": total})

    counted = docs.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).mapInPandas(bundle, "lang string, place int, value double")
    rows = summed.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector"))
    return rows.select("lang", F.col("vector.value").alias("vector")).orderBy("lang").toPandas()


def predict(docs: DataFrame, prototypes: pd.DataFrame) -> DataFrame:
    """Add lang_pred and score to docs, which has a text: the prototype with the largest cosine, and that cosine.

    `und` and 0 where a text is null, has no letter, or nothing was learned; the first language by name if several are
    equally near. Whole texts count, however long; equal texts get equal results, an empty table gives an empty table.
    Columns lang_pred and score are replaced, every other column of docs is kept.
    """
    small_batches(docs.sparkSession)
    langs = list(prototypes["lang"])
    matrix = np.array([np.asarray(v) / (np.linalg.norm(v) or 1) for v in prototypes["vector"]]).reshape(len(langs), DIMENSIONS)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # a vector for each language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bundles()
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            found = [(i, grams) for i, text in enumerate(batch.column("text").to_pylist() if langs else ()) if (grams := Letters.grams(text)) is not None]
            if found:
                own = known.of([grams for _, grams in found])
                cosines = own @ shared.value.T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1)
                for (i, _), best, cosine in zip(found, cosines.argmax(1), cosines.max(1), strict=True):
                    names[i], scores[i] = langs[best], min(max(cosine, 0), 1)
            kept = [c for c in batch.schema.names if c not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(judge, and_columns(docs, "lang_pred string, score double"))
