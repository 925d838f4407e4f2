"""Hard negatives by bit-sliced integer products.

Components are integers in two's complement, kept as bit-planes. A product is summed from the most significant plane down; what the
planes below can still add lies in an interval that narrows with each plane, and a candidate is dropped once its interval can't qualify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import cut, drop, small_batches

#: Rows in a shard at most, rows from which a table has several, and anchors that search a shard in one task.
SHARD_ROWS, LEAST_ROWS, BLOCK_ANCHORS = 65536, 2048, 65536
#: Anchors and rows that are multiplied at once.
TILE = 512, 1024
#: Share of a tile's pairs below which those left are followed one by one.
SPARSE = 1 / 8
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Planes:
    """Integer vectors of one length as bit-planes, the sign's plane last."""

    def __init__(self, rows: list[bytes], length: int, bits: int):
        self.length, self.bits = length, bits
        self.packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), bits, -(-length // 8))

    def __getitem__(self, rows) -> Planes:
        out = object.__new__(Planes)
        out.length, out.bits, out.packed = self.length, self.bits, self.packed[rows]
        return out

    def __len__(self) -> int:
        return len(self.packed)

    def plane(self, k: int) -> np.ndarray:
        return np.unpackbits(self.packed[:, k], axis=1, count=self.length)

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits - 1 else 1 << k

    def values(self) -> np.ndarray:
        return sum(self.plane(k).astype(np.int64) * self.weight(k) for k in range(self.bits)) if self.length else np.zeros((len(self), 0), np.int64)


def slice_bits(codes: np.ndarray, bits: int) -> list[bytes]:
    """The bit-planes of each row of integers, packed."""
    planes = (codes[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(np.uint8)
    return [x.tobytes() for x in np.packbits(planes, axis=2)] if codes.shape[1] else [b""] * len(codes)


class Best:
    """The k best (score, id) so far of each question, and the limits within which a score is of use.

    Questions are grouped by anchor, `each` to one. A score qualifies if it lies from floor to ceiling; once k do, the floor is the k-th.
    """

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.floor, self.ceiling, self.k = floor.astype(np.int64), ceiling.astype(np.int64), k
        self.unbounded = floor.shape[1] == 1 and bool((ceiling == _HIGH).all())
        self.question, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        each = self.floor.shape[1]
        fits = (score[:, None] >= self.floor[anchor]) & (score[:, None] <= self.ceiling[anchor])
        pair, slot = np.nonzero(fits)
        q = np.concatenate([self.question, anchor[pair] * each + slot])
        s, i = np.concatenate([self.score, score[pair]]), np.concatenate([self.id, ids[pair]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = _ranks(q)
        full = rank == self.k - 1
        self.floor.reshape(-1)[q[full]] = s[full]
        kept = rank < self.k
        self.question, self.score, self.id = q[kept], s[kept], i[kept]


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each entry among its equals."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


def match_tile(values: np.ndarray, rows: Planes, allowed: np.ndarray, best: Best, at: np.ndarray, ids: np.ndarray) -> int:
    """Bring into best what rows (with ids) have for the anchors whose integers are values and whose places in best are at.

    allowed: the pairs that count. Returns the number of products of a pair and a plane that were formed.
    """
    least, most = np.minimum(values, 0).sum(1), np.maximum(values, 0).sum(1)  # what a plane can add, for its weight
    kind = np.float32 if (most - least).max(initial=0) < 1 << 24 else np.float64  # sums in it are exact
    left, sums = values.astype(kind), np.zeros(allowed.shape, np.int64)
    pairs, done, k = None, 0, rows.bits
    while pairs is None and k:
        k -= 1
        sums += rows.weight(k) * (left @ rows.plane(k).T.astype(kind)).astype(np.int64)
        done += allowed.size
        rest = (1 << k) - 1
        low_edge, high_edge = best.floor[at].min(1) - rest * most, best.ceiling[at].max(1)
        if best.unbounded and k <= rows.bits // 2 and len(rows) > best.k:  # then the k-th best of the lower ends is a floor too
            sure = np.where(allowed, sums, _LOW // 2)
            kth = np.partition(sure, len(rows) - best.k, axis=1)[:, len(rows) - best.k]
            low_edge = np.maximum(low_edge, kth + rest * least - rest * most)
        alive = allowed & (sums >= low_edge[:, None])
        if (high_edge < _HIGH).any():
            alive &= sums <= (high_edge - np.where(high_edge < _HIGH, rest * least, 0))[:, None]
        if not k or alive.mean() < SPARSE:
            pairs = np.nonzero(alive)
    i, j = pairs
    s = sums[i, j]
    while k and len(i):
        k -= 1
        plane = rows.plane(k)
        for part in np.array_split(np.arange(len(i)), -(-len(i) // 65536)):
            s[part] += rows.weight(k) * np.einsum("pd,pd->p", left[i[part]], plane[j[part]].astype(kind)).astype(np.int64)
        done += len(i)
        rest = (1 << k) - 1
        low, high = s + rest * least[i], s + rest * most[i]
        useful = ((high[:, None] >= best.floor[at[i]]) & (low[:, None] <= best.ceiling[at[i]])).any(1)
        i, j, s = i[useful], j[useful], s[useful]
    best.add(at[i], s, ids[j])
    return done


def _tiles(n: int, step: int) -> Iterator[slice]:
    return (slice(a, a + step) for a in range(0, n, step))


def best_same_label(anchors: pd.DataFrame, shard: pd.DataFrame, length: int, bits: int, k: int) -> pd.DataFrame:
    """The k best rows of a shard of each anchor's own label; both have vec_id, label, planes."""
    best = Best(np.full((len(anchors), 1), _LOW // 2), np.full((len(anchors), 1), _HIGH), k)
    ids, rows = shard["vec_id"].to_numpy(), Planes(shard["planes"].tolist(), length, bits)
    places = shard.groupby("label").indices
    asked, asked_ids = Planes(anchors["planes"].tolist(), length, bits), anchors["vec_id"].to_numpy()
    for label, mine in anchors.groupby("label").indices.items():
        there = places.get(label, np.zeros(0, int))
        for a in _tiles(len(mine), TILE[0]):
            values = asked[mine[a]].values()
            for b in _tiles(len(there), TILE[1]):
                other = asked_ids[mine[a]][:, None] != ids[there[b]][None, :]
                match_tile(values, rows[there[b]], other, best, mine[a], ids[there[b]])
    found = anchors.iloc[best.question]
    return pd.DataFrame({"anchor_id": found["vec_id"].to_numpy(), "uid": found["uid"].to_numpy(), "vec_id": best.id, "score": best.score})


def best_other_labels(anchors: pd.DataFrame, shard: pd.DataFrame, length: int, bits: int, k: int, low: int, high: int) -> pd.DataFrame:
    """The k best rows of a shard of other labels, for each anchor and each of its positives (positive_id, positive_score: lists),
    with low * positive <= 100 * score <= high * positive."""
    each = anchors["positive_score"].map(len).max()
    scores = np.array([[*x, *[0] * (each - len(x))] for x in anchors["positive_score"]], dtype=np.int64).reshape(len(anchors), each)
    given = np.arange(each)[None, :] < anchors["positive_score"].map(len).to_numpy()[:, None]
    floor, ceiling = np.where(given, -(-low * scores // 100), _HIGH // 2), np.where(given, high * scores // 100, _LOW // 2)
    best = Best(floor, ceiling, k)
    ids, labels, rows = shard["vec_id"].to_numpy(), shard["label"].to_numpy(), Planes(shard["planes"].tolist(), length, bits)
    asked, asked_labels, asked_ids = Planes(anchors["planes"].tolist(), length, bits), anchors["label"].to_numpy(), anchors["vec_id"].to_numpy()
    for a in _tiles(len(anchors), TILE[0]):
        values, at = asked[a].values(), np.arange(len(anchors))[a]
        for b in _tiles(len(shard), TILE[1]):
            apart = (asked_labels[a][:, None] != labels[b][None, :]) & (asked_ids[a][:, None] != ids[b][None, :])
            match_tile(values, rows[b], apart, best, at, ids[b])
    row, slot = np.divmod(best.question, each)
    found = anchors.iloc[row]
    positive = [x[s] for x, s in zip(found["positive_id"], slot, strict=True)]
    return pd.DataFrame({"anchor_id": found["vec_id"].to_numpy(), "uid": found["uid"].to_numpy(), "slot": slot.astype("int32"), "positive_id": np.array(positive, np.int64), "positive_score": scores[row, slot], "vec_id": best.id, "score": best.score})


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, label, embedding).

    Each component becomes floor(scale * x), and a score is the integer product of two rows; higher scores come first, ties
    by vec_id. An anchor, a row for which the condition `anchors` holds, has as positives its first `positives` other rows
    of its label, and for each of them as negatives the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Fewer where there are fewer, none where none qualifies.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Equal rows count once, rows
    of an anchor's own vec_id are never its positives or negatives, and rows of one vec_id but other content are rows
    of their own. Vectors meet those of their own length. An empty table has no rows. Components so large that a score
    might not fit a long are an error. Other columns don't matter. What is compared grows with anchors times rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    coded = cut(usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), codes.alias("codes")).distinct())
    n, asked, lowest, highest, longest = coded.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.min(F.array_min("codes")), F.lit(0)), F.coalesce(F.max(F.array_max("codes")), F.lit(0)), F.coalesce(F.max(F.size("codes")), F.lit(0))).first()
    bits = max(highest.bit_length(), (~lowest).bit_length() if lowest < 0 else 0) + 1
    if longest * max(1, 1 << bits - 1) ** 2 * 100 >= 1 << 62:
        raise ValueError("components are too large for scores in a long")

    def sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, rows in frame.groupby(frame["codes"].map(len)) if len(frame) else ():
                planes = slice_bits(np.array(rows["codes"].tolist(), np.int64).reshape(len(rows), length), bits)
                yield rows.drop(columns="codes").assign(length=np.int32(length), planes=planes)

    table = cut(coded.withColumn("uid", F.xxhash64("vec_id", "label", "codes")).mapInPandas(sliced, "vec_id long, label long, anchor boolean, uid long, length int, planes binary"))
    drop(coded)
    shards = max(1, -(-n // max(LEAST_ROWS, min(SHARD_ROWS, n // spark.sparkContext.defaultParallelism + 1))))
    blocks = max(1, -(-asked // BLOCK_ANCHORS))
    by = ["length", "shard", "block"]

    def dealt(asking: DataFrame):
        """Each shard of rows together with each block of anchors."""
        rows = table.select("vec_id", "label", "length", "planes", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        copies = asking.withColumn("block", F.pmod(F.xxhash64("uid", "vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return copies.groupBy(*by).cogroup(rows.groupBy(*by))

    def first_of(found: DataFrame, of: list[str], k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)

    def same(asking: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(shard):
            return pd.DataFrame({c: [] for c in ("anchor_id", "uid", "vec_id", "score")})
        return best_same_label(asking, shard, int(asking["length"].iloc[0]), bits, positives)

    asking = table.filter("anchor").select("vec_id", "uid", "label", "length", "planes")
    found = first_of(dealt(asking).applyInPandas(same, "anchor_id long, uid long, vec_id long, score long"), ["anchor_id", "uid"], positives)
    chosen = found.groupBy("anchor_id", "uid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x"))  # at most `positives`
    asking = cut(asking.join(chosen.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "uid"]).select("vec_id", "uid", "label", "length", "planes", F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("positive_score")))

    def others(asking: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(shard):
            return pd.DataFrame({c: [] for c in ("anchor_id", "uid", "slot", "positive_id", "positive_score", "vec_id", "score")})
        return best_other_labels(asking, shard, int(asking["length"].iloc[0]), bits, negatives, low, high)

    found = dealt(asking).applyInPandas(others, "anchor_id long, uid long, slot int, positive_id long, positive_score long, vec_id long, score long")
    best = cut(first_of(found, ["anchor_id", "uid", "slot"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    drop(table, asking)
    return best
