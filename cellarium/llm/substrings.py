"""Passages that repeat across documents: windows of words, level by level from short ones to twice their length.

A window of `least` words can repeat only if each shorter window in it does. So the first level hashes short windows, and of
those only one for each window of `least` words, picked by its content: the one with the smallest hash, so that equal windows pick
equal parts. What repeats is extended to twice the length and asked again, until no candidates survive or `least` is reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import HOT_ROWS, cut, drop, salted, small_batches, spread_join

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Words of texts, about, that are hashed together.
WORDS_AT_ONCE = 1 << 19
#: Bits of a text's hash that tell rows of one doc_id apart where that is enough, so that shuffles carry less.
_SHORT = 0xFFFF


class _Powers:
    """The powers of the base and of its inverse modulo 2 to the 64th, as far as asked for; they grow with the longest text of a task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


class Windows:
    """Hashes of the windows of words of several texts, one after another, by polynomials of the words' hashes modulo 2 to the 64th."""

    def __init__(self, texts: list[list[bytes]], powers: _Powers):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n = int(self.lengths.sum())
        self.up, self.down = powers(self.n + 1)
        self.own = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for words in texts for w in words]), np.uint64).reshape(self.n, 2)
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, size: int, at: np.ndarray | slice = slice(None), which: int = 0) -> np.ndarray:
        """Of the windows of `size` words that start at the places `at`, be they in one text or not; which: 0 or 1, for another hash."""
        if which not in self.sums:
            self.sums[which] = np.r_[np.uint64(0), np.cumsum(self.own[:, which] * self.up[: self.n])]
        sums = self.sums[which]
        h = (sums[size:][at] - sums[: self.n - size + 1][at]) * self.down[: self.n - size + 1][at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def parts(self, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of `least` words begin that lie in one text, and for each where the part of `size` words begins that
        stands for it: the one with the smallest hash, the first of several."""
        h, m = self.hashes(size), self.n - least + 1
        smallest, at = h[:m].copy(), np.arange(m)
        for j in range(1, least - size + 1):
            other = h[j : j + m]
            np.copyto(at, np.arange(j, j + m), where=other < smallest)
            np.minimum(smallest, other, out=smallest)
        inside = np.arange(m) + least <= np.repeat(self.starts + self.lengths, self.lengths)[:m]
        return np.flatnonzero(inside), at[inside]


def levels(least: int) -> list[int]:
    """Lengths of the windows of each level: about half of `least` words, and from there twice as many up to it."""
    out = [max(1, -(-least // 2))]
    while out[-1] < least:
        out.append(min(2 * out[-1], least))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _occurrences(docs: DataFrame, least: int, sizes: list[int], level: int) -> DataFrame:
    """h, h2, doc_id, text_hash, at: windows of the level's length that stand for candidates of the level before.

    docs: doc_id, text_hash, text, and from the second level on `held`, the places that survived. h2, a second hash, is 0 before the last level.
    """
    last = sizes[level] == least

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            texts = [text.split() for text in batch.column("text").to_pylist()]
            before = np.cumsum([0, *map(len, texts)]) // WORDS_AT_ONCE
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(before[:-1])) + 1):
                windows = Windows([texts[i] for i in some], powers)
                if windows.n < least:
                    continue
                begin, at = windows.parts(least, sizes[0])
                if level:
                    # A window goes on if the part that stood for it did; from its first part on it grows to the left or right, within the window.
                    held = batch.column("held").take(pa.array(some))
                    alive = np.zeros(windows.n, bool)
                    alive[np.asarray(held.flatten(), np.int64) + np.repeat(windows.starts, np.asarray(held.value_lengths()))] = True
                    goes_on = alive[np.minimum(at, begin + least - sizes[level - 1])]
                    at = np.minimum(at, begin + least - sizes[level])[goes_on]
                at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at  # they never decrease
                text = np.repeat(np.arange(len(some)), windows.lengths)[at]
                second = (windows.hashes(sizes[level], at, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32) if last else np.zeros(len(at), np.int32)
                row = pa.array(some[text])
                columns = [pa.array(windows.hashes(sizes[level], at).view(np.int64)), pa.array(second), batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array((at - windows.starts[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "h2", "doc_id", "text_hash", "at"])

    return docs.mapInArrow(of, "h long, h2 int, doc_id long, text_hash long, at int")


def repeated_windows(docs: DataFrame, least: int = 13) -> DataFrame:
    """doc_id, text_hash and held: where those windows of `least` words begin that also begin in a document of a smaller doc_id.

    docs: doc_id, text_hash, text (binary). One row for each document that has such windows. Windows of the last level are
    told apart by 96 bits of hashes, those of earlier levels by 64, where a chance hit only makes one more candidate.
    """
    sizes, held = levels(least), None
    for level, size in enumerate(sizes):
        asked = docs if held is None else docs.join(held, ["doc_id", "text_hash"])
        seen = cut(_occurrences(asked, least, sizes, level))
        if held is not None:
            drop(held)
        last = size == least
        on = ["h", "h2"] if last else ["h"]
        shared = cut(seen.groupBy(*on).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other"), F.count("*").alias("n")).filter("first < other"))
        found = spread_join(seen.drop(*({"h2"} - set(on))), shared.select(*on, "first"), on, hot=salted(shared.filter(F.col("n") > HOT_ROWS).select(*on, "n"), on))
        if last:
            found = found.filter("doc_id > first")
        held = cut(found.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("held")))  # at most one for each word of a document
        drop(seen, shared)
        if not last and held.isEmpty():
            return held
    return held


def remove_repeats(docs: DataFrame, least: int = 13) -> DataFrame:
    """docs (doc_id, text) without the words of passages that an earlier document has: doc_id, text_hash, n_words, n_removed, kept.

    A word, between ASCII white space, goes if a window of `least` consecutive words covers it whose words also stand, in
    this order, in a document of a smaller doc_id, be they removed there or not. kept: the other words, joined by one space.
    A null text is empty; a text of fewer words loses none. A null doc_id is neither smaller nor larger than another: such a
    row loses nothing and takes nothing from others. Rows of equal doc_id are one document in this and each has its own result; equal
    rows have equal results. Whole texts count, however long; an empty table stays empty; other columns don't matter.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs)
    # Rows of one doc_id are told apart by a few bits of their hashes unless these are equal for different texts.
    short = F.col("text_hash").bitwiseAND(F.lit(_SHORT).cast("long"))
    clashes = rows.groupBy("doc_id", short.alias("short")).agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b")
    if clashes.isEmpty():
        rows = rows.withColumn("text_hash", short)
    held = repeated_windows(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"), least)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text"), batch.column("held"), strict=True):
                words = (text.as_py() or b"").split()
                if not starts.is_valid:
                    out.append((len(words), 0, b" ".join(words)))
                    continue
                step = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(starts.values, np.int64)
                step[at] += 1
                step[at + least] -= 1
                gone = np.cumsum(step[:-1]) > 0
                out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n_words", "n_removed", "kept"])

    joined = rows.join(held, ["doc_id", "text_hash"], "left")  # a key's rows are copies of one row, one in all but odd tables
    return joined.select("doc_id", "text_hash", "text", "held").mapInArrow(rest, "doc_id long, text_hash long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
