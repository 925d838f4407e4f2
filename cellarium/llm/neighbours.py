"""Nearest neighbours by cosine: vantage-point trees, one per shard, with pruning relaxed by a factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import cut

#: The index takes its pivots, one for so many vectors and at most so many, from the smallest hashes of vec_id.
PIVOT_VECTORS, MOST_PIVOTS = 8192, 2048
#: Vectors in a shard, about, and queries that search a shard in one task.
SHARD_VECTORS, BLOCK_QUERIES = 16384, 2048
#: Pivots from which each shard knows its least and largest distance, besides its own.
RINGS = 8
#: Points in a leaf of a tree, and candidates for a vantage point and points by which they are judged.
LEAF, CANDIDATES, JUDGES = 64, 16, 256
#: Share of a query's k-th distance beyond which a bound prunes; one is exact.
FACTOR = 0.18
#: What rounding may add to a bound.
SLACK = 1e-6


def _sorted_best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -sims), axis=-1)[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


def _far(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * sims, 0, 4))


class VantageTree:
    """Unit vectors in a binary tree: each node splits its points at their median distance from a vantage point."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.vantages: list[int] = []
        self.medians: list[float] = []
        self.leaves: list[tuple[np.ndarray, list[tuple[int, bool]]]] = []  # points, and the turns that lead to them
        self._grow(np.arange(len(unit)), [])

    def _grow(self, points: np.ndarray, turns: list[tuple[int, bool]]) -> None:
        inner = None
        if len(points) > LEAF:
            tried = points[np.linspace(0, len(points) - 1, CANDIDATES).astype(int)]
            judges = points[np.linspace(0, len(points) - 1, min(JUDGES, len(points))).astype(int)]
            vantage = tried[np.argmax(_far(self.unit[tried] @ self.unit[judges].T).var(axis=1))]  # the widest spread splits best
            far = _far(self.unit[points] @ self.unit[vantage])
            median = float(np.median(far))
            inner = far <= median
        if inner is None or inner.all():  # few points, or many at one distance: nothing to split
            self.leaves.append((points, turns))
            return
        at = len(self.vantages)
        self.vantages.append(vantage)
        self.medians.append(median)
        self._grow(points[inner], [*turns, (at, True)])
        self._grow(points[~inner], [*turns, (at, False)])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least distance that each unit query can have from the points of each leaf, by the triangle inequality."""
        out = np.zeros((len(queries), len(self.leaves)))
        if self.vantages:
            beyond = _far(queries @ self.unit[self.vantages].T) - np.array(self.medians)
            for j, (_, turns) in enumerate(self.leaves):
                for at, inner in turns:
                    np.maximum(out[:, j], beyond[:, at] if inner else -beyond[:, at], out=out[:, j])
        return out

    def search(self, queries: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Similarities (-inf where there are fewer) and places of the k nearest points of each unit query, and how many
        pairs were compared.

        A query visits leaves in the order of their bounds, twice as many in each round, until the next bound exceeds
        factor times its k-th distance so far, or its bound from elsewhere if that is smaller.
        """
        sims, places = np.full((len(queries), k), -np.inf), np.full((len(queries), k), len(self.unit))
        limit, least = bounds.astype(float).copy(), self.bounds(queries)
        order = np.argsort(least, axis=1, kind="stable")
        first, step, compared = 0, 1, 0
        active = np.arange(len(queries))
        while first < len(self.leaves) and len(active):
            wanted = order[active, first : first + step]
            open_ = np.take_along_axis(least[active], wanted, 1) - SLACK <= factor * limit[active, None]
            for j in np.unique(wanted[open_]):
                mine = active[((wanted == j) & open_).any(axis=1)]
                mine = mine[least[mine, j] - SLACK <= factor * limit[mine]]
                points = self.leaves[j][0]
                # Rounded, so that equal vectors tie whatever block they are multiplied in.
                near = np.round(queries[mine] @ self.unit[points].T, 12)
                compared += near.size
                found = np.concatenate([sims[mine], near], 1)
                where = np.concatenate([places[mine], np.broadcast_to(points, near.shape)], 1)
                sims[mine], places[mine] = _sorted_best(found, where, k)
                limit[mine] = np.minimum(limit[mine], _far(sims[mine, -1].clip(-1, 1)))
            active = active[open_.any(axis=1)]
            first, step = first + step, step * 2
        return sims, places, compared


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of distinct rows that have both, with finite components that aren't all zero."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & F.exists("embedding", lambda x: x != 0)).distinct()


class Pivots:
    """The pivots of each length of vectors, as unit rows; a length without one has a single region, -1."""

    def __init__(self, rows: list):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r["embedding"]) for r in rows}:
            mine = [i for i, r in enumerate(rows) if len(r["embedding"]) == n]
            self.by_length[n] = np.array(mine), _unit(np.array([rows[i]["embedding"] for i in mine], dtype=float))

    def far(self, frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, int, np.ndarray, np.ndarray]]:
        """The rows of each length with that length, the numbers of its pivots and the distances from them."""
        for n, rows in frame.groupby(frame["embedding"].map(len)):
            numbers, unit = self.by_length.get(n, (np.array([-1]), None))
            sims = np.ones((len(rows), 1)) if unit is None else _unit(_matrix(rows["embedding"])) @ unit.T
            yield rows, n, numbers, _far(sims)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query (vec_id, embedding) other than its own vec_id.

    Returns query_id, rank (from 1), vec_id, score (cosine), nearest first and ties to the smaller vec_id; fewer rows
    where there are fewer others. Rows that usable() leaves out take no part; a query's neighbours are vectors of its
    own length. Equal rows count once; an empty table has no neighbours. Other columns don't matter.

    Among equal vectors only the k + 1 with the smallest ids can be among the nearest, and equal queries are searched
    once. Every vector goes to its nearest pivot's shards. A query searches the shards of its own pivot first; the
    distance that it has then, times factor, says which other pivots it visits: their shards lie in a ring around
    each of several pivots. What is compared grows with queries times vectors as far as bounds do not prune.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    good = usable(vectors)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    points = cut(good.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    asked = usable(queries).withColumn("embedding", F.col("embedding").cast(kind))
    keys = asked.groupBy("embedding").agg(F.min("vec_id").alias("key"))
    members = asked.join(keys, "embedding").select(F.col("vec_id").alias("query_id"), "key")

    n = points.count()
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, max(1, n // PIVOT_VECTORS))).collect()
    pivots = spark.sparkContext.broadcast(Pivots(chosen))  # at most MOST_PIVOTS

    def assign(frames):
        for frame in frames:
            for rows, length, numbers, far in pivots.value.far(frame) if len(frame) else ():
                home = far.argmin(1)
                rings = [far[:, i] if i < far.shape[1] else np.zeros(len(rows)) for i in range(RINGS)]
                yield rows.assign(length=np.int32(length), pivot=numbers[home].astype("int32"), far=far[np.arange(len(rows)), home], rings=list(np.array(rings).T))

    placed = cut(points.mapInPandas(assign, f"vec_id long, embedding {kind}, length int, pivot int, far double, rings array<double>"))
    ring = [f(F.col("rings")[i]).alias(f"{name}{i}") for i in range(RINGS) for name, f in (("low", F.min), ("high", F.max))]
    shapes = {(r["length"], r["pivot"]): r for r in placed.groupBy("length", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"), *ring).collect()}  # a row for each pivot
    salts = {i: -(-r["n"] // SHARD_VECTORS) for i, r in shapes.items()}

    def search(visits: DataFrame) -> DataFrame:
        """visits: key, embedding, length, pivot, bound. Returns key, vec_id, score: the best of each shard that is visited."""
        loads = {(r["length"], r["pivot"]): -(-r["count"] // BLOCK_QUERIES) for r in visits.groupBy("length", "pivot").count().collect()}  # by pivot
        plan = spark.createDataFrame([(*i, salts[i], loads[i]) for i in loads if i in salts], "length int, pivot int, salts int, blocks int")
        plan = F.broadcast(plan)  # a row for each pivot
        sought = visits.join(plan, ["length", "pivot"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        shards = placed.join(plan, ["length", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))

        def in_shard(shard: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
            if not len(shard) or not len(sought):
                return pd.DataFrame({"key": [], "vec_id": [], "score": []})
            shard = shard.sort_values("vec_id", ignore_index=True)
            raw, ask = _matrix(shard["embedding"]), _matrix(sought["embedding"])
            sims, places, _ = VantageTree(_unit(raw)).search(_unit(ask), sought["bound"].to_numpy(), k + 1, factor)
            row, column = np.nonzero(np.isfinite(sims))
            at = places[row, column]
            # The measure on the original vectors; a row's sum does not depend on the other rows.
            score = (raw[at] * ask[row]).sum(1) / (np.sqrt((raw[at] ** 2).sum(1)) * np.sqrt((ask[row] ** 2).sum(1)))
            return pd.DataFrame({"key": sought["key"].to_numpy()[row], "vec_id": shard["vec_id"].to_numpy()[at], "score": score})

        by = ["length", "pivot", "salt", "block"]
        both = shards.select(*by, "vec_id", "embedding").groupBy(*by).cogroup(sought.select(*by, "key", "embedding", "bound").groupBy(*by))
        found = both.applyInPandas(in_shard, "key long, vec_id long, score double")
        return found.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)

    def homes(frames):
        for frame in frames:
            for rows, length, numbers, far in pivots.value.far(frame) if len(frame) else ():
                yield rows.assign(length=np.int32(length), pivot=numbers[far.argmin(1)].astype("int32"))

    at_home = cut(keys.mapInPandas(homes, f"embedding {kind}, key long, length int, pivot int"))
    first = cut(search(at_home.withColumn("bound", F.lit(2.0))))
    bound = first.filter(F.col("at") == k + 1).select("key", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))

    def others(frames):
        for frame in frames:
            for rows, length, numbers, far in pivots.value.far(frame) if len(frame) else ():
                for j, number in enumerate(numbers):
                    if (shape := shapes.get((length, number))) is None:
                        continue
                    least = far[:, j] - shape["radius"]
                    for i in range(min(RINGS, far.shape[1])):
                        least = np.maximum(least, np.maximum(far[:, i] - shape[f"high{i}"], shape[f"low{i}"] - far[:, i]))
                    near = (least - SLACK <= factor * rows["bound"].to_numpy()) & (rows["pivot"].to_numpy() != number)
                    yield rows[near].assign(pivot=np.int32(number))

    bounded = at_home.join(bound, "key", "left").select("key", "embedding", "length", "pivot", F.coalesce("bound", F.lit(2.0 / max(factor, 1e-9))).alias("bound"))
    second = search(cut(bounded.mapInPandas(others, f"key long, embedding {kind}, length int, pivot int, bound double")))
    found = first.drop("at").union(second.drop("at"))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1).drop("at")
    mine = members.join(best, "key").filter("vec_id <> query_id")
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
