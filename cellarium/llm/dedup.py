"""Near-duplicates: MinHash signatures, banding, verification, and connected components by alternating stars."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import cut, drop, fresh_name, salted, small_batches, spread_join

#: Minima in a signature, and the chance at most that a link at the threshold shares no band of it.
MINIMA, MISSED = 128, 1e-5
#: Words in a shingle.
SHINGLE = 5
#: Standard errors below the threshold at which a pair's signatures rule it out without a look at its sets.
ERRORS = 5
#: A shingle in at most so many of the texts that are still open is rare.
RARE = 16
#: Open members of a bucket that one task compares with the others.
BUCKET_ROWS = 2000
#: Up to so many ids the documents that pairs name are picked by a broadcast, beyond it by a shuffle.
BROADCAST_IDS = 1_000_000
_random = np.random.Generator(np.random.Philox(key=20240229))
_FACTORS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z in lower case, words between ASCII white space."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(SHINGLE, len(found))
    total = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of universal hashes (multiply, add, keep the high half) over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048, None] * _FACTORS + _TERMS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def banding(percent: int) -> tuple[int, int]:
    """Bands and their rows: the longest bands with which a link at the threshold is missed with a chance of MISSED at most."""
    t = percent / 100
    fits = [(MINIMA // r, r) for r in range(1, MINIMA + 1) if (1 - t**r) ** (MINIMA // r) <= MISSED]
    if not 0 < percent <= 100 or not fits:
        raise ValueError(f"percent {percent}: {MINIMA} minima do not find links of so little similarity")
    return fits[-1]


def least_agreement(percent: int) -> float:
    """The share of equal minima below which a pair is no link: ERRORS standard errors below the threshold."""
    t = percent / 100
    return t - ERRORS * (t * (1 - t) / MINIMA) ** 0.5


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    total = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in sig[: bands * rows].reshape(bands, rows).astype(np.uint64).T:
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def fingerprints(docs: DataFrame, percent: int = 75) -> DataFrame:
    """uid, doc_id, text_hash, n (size of the set), fp (hash of the whole set), sig (the low byte of each minimum), bands, body (the text, compressed)."""
    small_batches(docs.sparkSession)
    bands, each = banding(percent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                sig = signature(found)
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), sig.astype(np.uint8).tobytes(), band_keys(sig, bands, each), zlib.compress(text.encode("utf-8", "replace"), 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _TYPES, strict=True))], names=["doc_id", "text_hash", "n", "fp", "sig", "bands", "body"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(of, "doc_id long, text_hash long, n long, fp binary, sig binary, bands array<long>, body binary")
    return rows.withColumn("uid", F.monotonically_increasing_id())


_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]


def _bodies(prints: DataFrame, ids: DataFrame) -> DataFrame:
    """uid, sig and body of the rows of prints that ids (uid) names."""
    few = ids.count() <= BROADCAST_IDS
    return prints.select("uid", "sig", "body").join(F.broadcast(ids) if few else ids, "uid")


def rare_shingles(prints: DataFrame, ids: DataFrame) -> DataFrame:
    """uid, shingle, k of those shingles of these rows (ids: uid) that at most RARE of them have, and how many do."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, body in zip(batch.column("uid").to_pylist(), batch.column("body").to_pylist(), strict=True):
                found = shingles(zlib.decompress(body).decode()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), uid)), pa.array(found)], names=["uid", "shingle"])

    every = _bodies(prints, ids).select("uid", "body").mapInArrow(each, "uid long, shingle long")
    few = every.groupBy("shingle").agg(F.count("*").alias("k")).filter(F.col("k") <= RARE)
    return every.join(few, "shingle").select("uid", "shingle", "k")


def verify(pairs: DataFrame, prints: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b of uids) whose sets have 100 * intersection >= percent * union."""
    bodies = _bodies(prints, pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct())
    first = bodies.select(F.col("uid").alias("a"), F.col("sig").alias("sig_a"), F.col("body").alias("body_a"))
    second = bodies.select(F.col("uid").alias("b"), F.col("sig").alias("sig_b"), F.col("body").alias("body_b"))

    least = least_agreement(percent)

    def holds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                if (np.frombuffer(r.sig_a, np.uint8) == np.frombuffer(r.sig_b, np.uint8)).mean() < least:  # bytes agree at least as often as minima
                    continue
                if last[0] != r.a:
                    last = (r.a, shingles(zlib.decompress(r.body_a).decode()))
                x, y = last[1], shingles(zlib.decompress(r.body_b).decode())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((r.a, r.b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    joined = pairs.join(second, "b").join(first, "a")
    return joined.select("a", "b", "sig_a", "sig_b", "body_a", "body_b").sortWithinPartitions("a").mapInPandas(holds, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a > b) is either tied to one smaller node or the centre of such nodes."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b): large-star and small-star in turn."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while not _stars(now):
        # Large-star: every larger neighbour of a node is tied to the smallest of its neighbours and itself.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(spread_join(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small-star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, cut(small)
        drop(old, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def links(prints: DataFrame, percent: int = 75) -> DataFrame:
    """uid, doc_id, text_hash, n and component of every row of prints.

    Only one row of each distinct set is compared. Within a bucket each member is compared with one of them, that
    with most company in all its buckets: linear in the bucket. Links so found make components, and a pair within one
    needs no comparison. The rest of a bucket, members outside its largest component against all others, is compared
    too, in two parts that leave out only pairs which cannot be links. Pairs that share a rare shingle are found by it.
    For all others, m shingles of each of two sets of p and q that are not rare allow a similarity of
    m / (p + q - m) at most. So no link within a bucket is lost whatever its size.
    """
    same = cut(prints.filter("n > 0").groupBy("fp").agg(F.min("uid").alias("rep")))
    reps = prints.filter("n > 0").groupBy("fp").agg(F.min("uid").alias("uid"), F.min_by(F.struct("n", "bands"), "uid").alias("x"))
    keyed = cut(reps.select("uid", "x.n", F.explode("x.bands").alias("bucket")))
    shared = cut(keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    hot = salted(shared.withColumnRenamed("size", "n"), ["bucket"])
    members = cut(spread_join(keyed, shared.hint("merge"), ["bucket"], hot=hot).select("bucket", "uid", "n", "size"))
    drop(keyed, shared)

    def pairs_of(df: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes allow the similarity."""
        able = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        return df.filter(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*("bucket" if c == "bucket" else F.col(c).alias(name if c == "uid" else f"{c}_{name}") for c in df.columns))

    company = members.groupBy("uid").agg(F.sum("size").alias("company"))
    lead = members.join(company, "uid").groupBy("bucket").agg(F.max(F.struct("company", "uid", "n")).alias("x")).select("bucket", F.col("x.uid").alias("a"), F.col("x.n").alias("n_a"))
    first = cut(pairs_of(spread_join(side(members, "b"), lead, ["bucket"], hot=hot).filter("a <> b")))
    held = components(verify(first, prints, percent))
    drop(first)

    labelled = cut(members.filter("size > 2").join(held.withColumnRenamed("node", "uid"), "uid", "left").select("bucket", "uid", "n", F.coalesce("component", "uid").alias("component")))
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("main")).filter("parts > 1")
    still = cut(spread_join(labelled, parts, ["bucket"], hot=hot).select("bucket", "uid", "n", "component", "main"))
    drop(members, labelled)
    if not still.isEmpty():
        whole = still.groupBy("uid").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.collect_set("bucket").alias("buckets"))  # at most one for each band
        rare = cut(rare_shingles(prints, whole.select("uid")))
        named = rare.filter("k > 1").join(whole.select("uid", "n", "component"), "uid").groupBy("shingle").agg(F.collect_list(F.struct("uid", "n", "component")).alias("x"))  # at most RARE
        near = named.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).filter("p.uid < q.uid AND p.component <> q.component")
        near = pairs_of(near.select(F.col("p.uid").alias("a"), F.col("p.n").alias("n_a"), F.col("q.uid").alias("b"), F.col("q.n").alias("n_b")))

        m = F.col("n") - F.coalesce("rare", F.lit(0))
        bounded = whole.join(rare.groupBy("uid").agg(F.count("*").alias("rare")), "uid", "left").select("uid", m.alias("m"), "buckets").filter(m * 100 >= F.col("n") * percent)
        open_ = cut(still.join(bounded, "uid"))
        common = F.least("m_a", "m_b")
        able = common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent
        apart = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
        once = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
        # A bucket's members are dealt to as many tasks as their number asks for; those outside its main component go to all of them.
        dealt = open_.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("salts"))
        few = open_.filter("component <> main").join(dealt, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        every = open_.join(dealt, "bucket").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int")).drop("salts")
        left, right = side(few, "a").withColumnRenamed("salt_a", "salt"), side(every, "b").withColumnRenamed("salt_b", "salt")
        rest = left.join(right.hint("merge"), ["bucket", "salt"]).filter(apart & able & once)
        more = cut(pairs_of(rest).union(near).distinct())
        drop(rare, open_)
        if not more.isEmpty():
            old = held.select(F.col("node").alias("a"), F.col("component").alias("b"))
            held = components(verify(more, prints, percent).unionByName(old))
    drop(still)
    by_set = same.join(held, same["rep"] == held["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    rows = prints.select("uid", "doc_id", "text_hash", "n", "fp")
    alone = rows.filter("n = 0").select("uid", "doc_id", "text_hash", "n", F.col("uid").alias("component"))
    return spread_join(rows.filter("n > 0"), by_set, ["fp"]).select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, uid, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach; a text that is null or has no words links with nothing. A
    null doc_id has links too but is never the smallest unless alone. kept: doc_id is component_id. Rows of equal
    doc_id and text are one group of several rows. Whole texts count, however long; an empty table gives an empty table. Other columns of docs don't matter; uid numbers the rows.
    """
    prints = cut(fingerprints(docs, percent))
    found = cut(links(prints, percent))
    drop(prints)
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return spread_join(found, smallest, ["component"]).select("doc_id", "uid", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id; all columns stay, whatever their names.

    Rows without words, null texts too, are in no group and stay. Of equal rows of one doc_id one stays. A null doc_id
    comes last. Whole texts count, however long; an empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, percent))
    found = links(prints, percent).filter("n > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "text_hash")
    kept = cut(found.groupBy("component").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_hash").alias("kept_hash")))
    several = prints.filter("n > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    drop(prints)
    mark = fresh_name(docs.columns, "_hash")
    rows = docs.withColumn(mark, F.xxhash64("text"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = rows.filter(wordy)
    some = some.join(kept, some["doc_id"].eqNullSafe(kept["kept_id"]) & (some[mark] == kept["kept_hash"]), "left_semi")
    if several:
        some = some.dropDuplicates(["doc_id", mark])
    return some.unionByName(rows.filter(~wordy)).drop(mark)
