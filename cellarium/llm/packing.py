"""Best-fit packing of documents into sequences of a fixed length, in bulk-synchronous rounds.

Documents are sorted and ranked by size on the cluster; a round needs no more than the counts of the sizes, of which
there are as many as a sequence has places, so the rounds run on that table and one join carries them out.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import cut, small_batches
from cellarium.llm.tokens import word_encoder

#: Least number of parts that the rows of one size are dealt to for ranking; the session's shuffle partitions if more.
RANK_PARTS = 64
#: Segments that may be broadcast: far more than the sizes of a sequence ever make; beyond it they are joined by shuffle.
BROADCAST_SEGMENTS = 200_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut every document's ids, end_id appended, into pieces of at most capacity ids.

    Returns doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32. A null text is empty
    and so has the one id end_id. Only a document of more than capacity ids has several pieces. Other columns of
    docs don't matter.
    """
    small_batches(docs.sparkSession)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), struct.pack("<I", end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(body) // 4, zlib.crc32(body)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PIECE_TYPES, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cuts, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def match(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rounds of best fit over counts of items by size, one size after another, largest first.

    In a round the items of a size go to their successor, the smallest gap that holds them, as many to a gap as fit;
    rank decides which item gets which gap, the gaps shrink, and the round goes on with the next larger gap. Where no gap is
    left they open sequences. Both tables have at most one entry for each size up to capacity; gaps of equal history
    stay together as a range of sequence numbers, which a round splits once at most.

    Returns segments (size, first, last, sequence, offset, each): item first + k of the size (k < last - first) stands
    in sequence + k // each at offset + k % each * size.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, opened = [], 0

    def add(free: int, first: int, last: int) -> None:
        if free and first < last:
            if free not in gaps:
                gaps[free] = []
                bisect.insort(sizes, free)
            gaps[free].append((first, last))

    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            at = bisect.bisect_left(sizes, size)
            if at < len(sizes):
                free = sizes[at]
                first, last = gaps[free].pop()
                if not gaps[free]:
                    del gaps[free], sizes[at]
            else:
                free, first = capacity, opened
                opened = last = opened + -(-(n - done) // (capacity // size))
            each = free // size
            full, rest = min(last - first, (n - done) // each), 0
            if full < last - first and done + full * each < n:
                rest = n - done - full * each
            if full:
                out.append((size, done, done + full * each, first, capacity - free, each))
                add(free - each * size, first, first + full)
                done += full * each
            if rest:
                out.append((size, done, done + rest, first + full, capacity - free, rest))
                add(free - rest * size, first + full, first + full + 1)
                done += rest
            add(free, first + full + bool(rest), last)
    return out


def _ranked(items: DataFrame) -> DataFrame:
    """items with rank (from 0) among the rows of equal length, ties by uid. A size's rows are ranked in parts."""
    parts = max(RANK_PARTS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = items.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most capacity x parts rows
    base = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    within = parted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1)
    return within.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place items into sequences: adds sequence_id and offset to columns that have uid and length.

    uid is unique and stays the same however often a row is computed; 0 < length <= capacity. Documents are sorted
    and ranked by size, match() sweeps over the counts of the sizes, and each item finds its place by its rank.
    """
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most capacity rows
    plan = pd.DataFrame(match(counts, capacity), columns=["size", "first", "last", "sequence", "at", "each"], dtype="int64")
    given = F.broadcast if len(plan) <= BROADCAST_SEGMENTS else (lambda df: df)
    segments = spark.createDataFrame(plan, "size long, first long, last long, sequence long, at long, each long")
    ranked, k = _ranked(items), F.col("rank") - F.col("first")
    return (
        ranked.join(given(segments), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div each"))
        .withColumn("offset", F.col("at") + F.pmod(k, F.col("each")) * F.col("size"))
        .drop("rank", *segments.columns)
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's pieces with sequence_id and offset; see pieces() and pack().

    An empty table gives no rows. Rows of equal or null doc_id are packed one by one.
    """
    cut_up = cut(pieces(docs, vocabulary, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    return pack(cut_up, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
