"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark words, in DataFrame operations only.

A window of w words occurs in a text only if all w occur there, so any one of them is a sufficient prefix: the rarest
over all documents is looked up, and where it stands in a text there is one place left where the window can begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import cut, fresh_name, spread_join

#: Rows and characters of windows up to which they are broadcast; beyond either the join is by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(chr(i) for i in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def words(text: Column) -> Column:
    """Runs of digits, a-z (A-Z in lower case) and everything beyond ASCII; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, window (its words joined by spaces), n: every run of `size` words of an item, or all of a shorter one."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return starts.select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window"), "n").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Judge docs (doc_id, text) by the items of benchmark (item_id, text).

    Returns doc_id, text_hash, n_words, n_hit (words inside any occurrence of an item's window), n_items (items with
    an occurring window), item_ids (sorted as strings) and contaminated (n_hit > 0), one row per row of docs. A null or wordless text
    has no hits; items with a null id or no words take no part; equal item rows count once. Rows of docs with equal doc_id are judged by
    their own texts. Whole texts count, however long; an empty table of documents gives an empty table, one of items hits
    nothing. Other columns of either table don't matter.
    """
    listed = windows(benchmark, size)
    distinct = listed.groupBy("window").agg(F.max("n").alias("n"))
    rows, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS
    given = F.broadcast if small else (lambda df: df)

    rows_of = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long")))  # words are cut once
    spots = rows_of.select("doc_id", "text_hash", "w", F.posexplode("w").alias("spot", "word"))

    in_windows = distinct.select("window", F.posexplode(F.split("window", " ")).alias("place", "word"))
    counts = rows_of.select(F.explode("w").alias("word")).join(given(in_windows.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("seen"))
    # Words that no document has lead to no place; a window with one of them is found through none, as it should be.
    prefix = in_windows.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "place")).alias("p"))
    probes = cut(prefix.join(distinct, "window").select(F.col("p.word").alias("word"), F.col("p.place").alias("place"), "window", "n"))

    start = F.col("spot") - F.col("place")
    if small:
        fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
        found = spots.join(given(probes), "word").filter(fits & (F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")), " ") == F.col("window")))
        hits = found.select("doc_id", "text_hash", start.alias("start"), "n", "window")
    else:
        by_word = probes.groupBy("word").agg(F.collect_list(F.struct("place", "window", "n")).alias("probe"))  # at most the windows of the benchmark
        near = spread_join(rows_of.select("doc_id", "text_hash", "n_words", F.posexplode("w").alias("spot", "word")), by_word, ["word"]).select("doc_id", "text_hash", "n_words", "spot", F.inline("probe"))
        near = near.filter((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "text_hash", start.alias("start"), "n", "window").distinct()
        same = near["doc_id"].eqNullSafe(rows_of["doc_id"]) & (near["text_hash"] == rows_of["text_hash"])
        found = near.join(rows_of.dropDuplicates(["doc_id", "text_hash"]), same).filter(F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ") == F.col("window"))
        hits = found.select(near["doc_id"], near["text_hash"], "start", "n", "window")
    hits = cut(hits)  # spans and items both follow from it

    spans = hits.select("doc_id", "text_hash", "start", "n").distinct()
    hit_words = spans.select("doc_id", "text_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("spot")).distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    items = hits.select("doc_id", "text_hash", "window").distinct().join(listed.select("window", "item_id"), "window").select("doc_id", "text_hash", "item_id").distinct()
    items = items.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))

    def key(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])

    every = rows_of.select("doc_id", "text_hash", "n_words")
    both = hit_words.join(items, key(hit_words, items)).select(hit_words["doc_id"], hit_words["text_hash"], "n_hit", "n_items", "item_ids")
    return every.join(both, key(every, both), "left").select(
        every["doc_id"], every["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Rows of docs (doc_id, text) without any hit; all columns stay, whatever their names.

    Null and wordless texts stay, equal rows stay or go together, whole texts count, and an empty table of either kind takes
    nothing away.
    """
    judged = decontaminate(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    mark = fresh_name(docs.columns, "_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    return marked.join(judged, marked["doc_id"].eqNullSafe(judged["hit_id"]) & (marked[mark] == judged["hit_hash"]), "left_anti").drop(mark)
