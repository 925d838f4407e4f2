"""Filter interaction audit: what each of five filters removes in every order, from counts of failure masks.

Duplicates are found by a range sort: rows are ranged by fingerprint and doc_id, sorted within a range by fingerprint,
full text and doc_id, and each is compared with its predecessor. What may have its predecessor in an earlier range, the first
and last fingerprints of a range, is settled afterwards from those few rows alone.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import cut, drop, small_batches

#: The filters, by letter; the bit of a letter in a mask is 1 shifted by its place.
LETTERS = "ABCDE"
_BITS = [1 << i for i in range(len(LETTERS))]
_ORDERS = ["".join(x) for x in itertools.permutations(LETTERS)]
_UPPER, _INNER = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))  # capitals, and bytes of UTF-8 that begin no code point
_COLUMNS = "fp long, doc_id long, part string, mask int, n long, text binary"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def failures(text: bytes, least_words: int, least_distinct: int, most_capitals: int, marks: bytes) -> int:
    """The mask of filters A to D that a text in UTF-8 fails."""
    words = text.split()
    short = len(words) < least_words
    repetitive = 100 * len(set(words)) < least_distinct * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > most_capitals * len(text.translate(None, _INNER))
    marked = len(text.translate(None, marks)) < len(text)
    return short | repetitive << 1 | loud << 2 | marked << 3


def masks(docs: DataFrame, least_words: int = 100, least_distinct: int = 80, most_capitals: int = 10, marks: str = "#$%&*|") -> DataFrame:
    """doc_id, part, mask and n: how many rows of docs (doc_id, text, lang) have this id and part and fail just these filters.

    A fails with fewer than least_words words between ASCII white space, B with less than least_distinct percent of them
    distinct, C with more than most_capitals percent of code points A-Z, D with any of marks, E with the very text of
    a smaller doc_id anywhere in the table. A null text is empty, a null lang the empty part. A null doc_id is neither smaller
    nor larger than another, so it never fails E; rows of equal doc_id and text fail it together or not at all. Whole texts count,
    an empty table has no rows, other columns of docs don't matter.
    """
    small_batches(docs.sparkSession)
    signs = marks.encode()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, least, mask = None, None, None, 0  # fingerprint, text and smallest id of the rows before, and what the text fails
        held: list = []  # the rows of this fingerprint that fail no E so far: text, mask, doc_id, how many by part
        at_edge = True  # whether the range began with this fingerprint

        def let_go(edge: bool) -> list:
            out = [(run, i, part, m, n, text if edge else None) for text, m, i, parts in held for part, n in parts.items()]
            held.clear()
            return out

        for batch in batches:
            out = []
            for fp, doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("fp", "doc_id", "part", "text")), strict=True):
                if fp != run:
                    out += let_go(at_edge)
                    at_edge, run, last = run is None, fp, None
                if text != last:
                    last, least, mask = text, None, failures(text, least_words, least_distinct, most_capitals, signs)
                if doc_id is None:
                    out.append((fp, None, part, mask, 1, None))
                elif least is None:
                    least = doc_id
                    held.append((text, mask, doc_id, Counter([part])))
                elif doc_id == least:
                    held[-1][3][part] += 1
                else:
                    out.append((fp, doc_id, part, mask | 16, 1, None))
            yield _batch(out)
        yield _batch(let_go(True))

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.spark_partition_id().alias("origin"))
    # The origin only deals out rows that are equal in all else.
    ranged = rows.select(F.xxhash64("text").alias("fp"), "doc_id", "part", F.col("text").cast("binary").alias("text"), "origin").repartitionByRange("fp", "doc_id", "origin")
    compared = cut(ranged.sortWithinPartitions("fp", "text", "doc_id").select("fp", "doc_id", "part", "text").mapInArrow(compare, _COLUMNS))
    edges = compared.filter("text IS NOT NULL")  # a text or two of each range
    first = edges.groupBy("fp", "text").agg(F.min("doc_id").alias("first"))
    settled = edges.join(first, ["fp", "text"]).withColumn("mask", F.when(F.col("doc_id") > F.col("first"), F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")))
    every = compared.filter("text IS NULL").select("doc_id", "part", "mask", "n").union(settled.select("doc_id", "part", "mask", "n"))
    found = cut(every.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))
    drop(compared)
    return found


def _batch(rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], names=["fp", "doc_id", "part", "mask", "n", "text"])


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows of each failure mask, and those whose labels (doc_id, quality, toxic) say quality = 1 or toxic = 1.

    Counters add up, so those of two tables of masks can be summed. Of several labels of a doc_id any counts, a null one does not, and a null doc_id has none.
    """
    known = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = found.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")))


def report(counted: DataFrame) -> DataFrame:
    """For each part of counters, all 120 orders of the filters and each of their 5 steps: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, as README says."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32
    steps = parts.select("*", F.explode(F.lit(_ORDERS)).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit_of = lambda letter: F.element_at(F.lit(_BITS), F.instr(F.lit(LETTERS), letter))
    before = F.aggregate(F.transform(F.split(F.substring("filter_order", 1, F.col("at")), ""), lambda x: F.when(x == "", 0).otherwise(bit_of(x))), F.lit(0), lambda a, x: a + x)
    placed = steps.withColumn("bit", F.element_at(F.lit(_BITS), F.instr(F.lit(LETTERS), F.col("letter")))).withColumn("before", F.when(F.col("at") == 0, 0).otherwise(before))

    def total(condition, value=lambda x: x["n"]):
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.when(condition(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    def fails(mask):
        return mask.bitwiseAND(F.col("bit")) != 0

    def gone(mask):
        return mask.bitwiseAND(F.col("before")) != 0

    return placed.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"),
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda m: fails(m) & ~gone(m)).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda m: fails(m) & ~gone(m), lambda x: x["good"]).alias("good_lost"),
        total(lambda m: fails(m) & ~gone(m), lambda x: x["toxic"]).alias("toxic_lost"),
        # Of the orders of all filters, those in which this one comes first among the filters of a mask: one in as many as the mask has.
        total(fails, lambda x: x["n"] * len(_ORDERS) / F.bit_count(x["mask"])).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """report() over counters() over masks() of docs (doc_id, text, lang); see there for odd rows. settings: those of masks()."""
    found = masks(docs, **settings)
    counted = cut(counters(found, labels))
    drop(found)
    return report(counted)
