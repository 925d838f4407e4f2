"""Token ids, and files of them that give any id without decoding a block.

The file format is a table of blocks; a block holds the ids of whole documents as directly addressable codes:
an id is cut into chunks of eight bits, level 0 has the lowest chunk of every id, and a bitmap says which ids go
on to the next level, whose entries stand in the same order. A directory of the bits set before each group of the
bitmap leads from an entry to its place one level deeper.
"""

from __future__ import annotations

import array
import functools
import json
import pathlib
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import small_batches

#: Ids in a block, over which a new block starts at the next document.
BLOCK_IDS = 1 << 19
#: Words whose ids a Python worker remembers: about 60 MB when full.
WORDS_KEPT = 300_000

_MAGIC = b"DAC1"
_CHUNK = 8
_GROUP = 512  # bits of the bitmap for each entry of its rank directory
_PUNCTUATION = ".,!?;:%&$#*()-/+=\""
# How a vocabulary file that lowers the case, drops white space and spells bytes says so.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def splits_at_blanks(path: str) -> bool:
    """Whether a vocabulary file is one that WordEncoder may read word by word: it lowers the case, drops white space between
    words and spells bytes."""
    file = json.loads(pathlib.Path(path).read_text())
    return {k: file.get(k) for k in _BY_WORD} == _BY_WORD and file["model"].get("type") == "BPE" and not file["model"].get("dropout") and not file["model"].get("continuing_subword_prefix")


class WordEncoder(dict):
    """Ids of a text, with those of each blank-separated word remembered.

    Where the vocabulary's pre-tokenizer never joins what white space separates, a text's ids are its words' ids in
    order, and plain Latin words go to the model directly. All else, and all text of other vocabularies, takes the library's whole path.
    """

    def __init__(self, path: str, keep: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_word = splits_at_blanks(path)
        self.keep = keep
        self.byte_letters = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        for b in range(256):  # the byte-level alphabet: bytes that do not print stand for letters from U+0100 on
            self.byte_letters[b] = b if b in shown else 256 + len([x for x in range(b) if x not in shown])

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if len(core) < len(word) and core and core.isalpha():
            packed = self[core] + self[word[len(core) :]]
        elif (core == word and core.isalpha() or not core and word) and (core.isascii() or max(core) < "\u0250" and is_normalized("NFC", core)):
            low = core.lower() or word
            letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.byte_letters)
            packed = array.array("I", [t.id for t in self.model.tokenize(letters)]).tobytes() if low.isalpha() or not core else self.slow(word)
        else:
            packed = self.slow(word)
        if len(self) < self.keep:
            self[word] = packed
        return packed

    def slow(self, text: str) -> bytes:
        """Ids by the library's whole path."""
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if not self.by_word:
            return self.slow(text)
        if "<|" not in text and "Σ" not in text:  # special tokens' case counts; a last sigma has a lower case of its own
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    return WordEncoder(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def dac_encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    level, parts = ids.astype(np.uint32), []
    while True:
        more = level >> _CHUNK
        goes_on = more != 0
        bits = np.packbits(goes_on, bitorder="little")
        groups = np.add.reduceat(goes_on, np.arange(0, len(level), _GROUP), dtype=np.int64) if len(level) else np.zeros(0, np.int64)
        rank = np.concatenate(([0], np.cumsum(groups)[:-1])).astype("<u4") if len(groups) else np.zeros(0, "<u4")
        parts.append((len(level), (level & ((1 << _CHUNK) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes()))
        if not goes_on.any():
            break
        level = more[goes_on]
    return _MAGIC + struct.pack("<B", len(parts)) + b"".join(struct.pack("<Q", n) for n, _ in parts) + b"".join(x for _, x in parts)


def _levels(block: bytes) -> list[tuple[int, int, int, int]]:
    """Length of each level and where its chunks, its bitmap and its rank directory begin."""
    if block[:4] != _MAGIC:
        raise ValueError("not a block of directly addressable codes")
    sizes = struct.unpack_from(f"<{block[4]}Q", block, 5)
    at, out = 5 + 8 * len(sizes), []
    for n in sizes:
        bitmap = at + n
        rank = bitmap + -(-n // 8)
        out.append((n, at, bitmap, rank))
        at = rank + 4 * -(-n // _GROUP)
    return out


def dac_get(block: bytes, i: int) -> int:
    """The id at place i, from at most one chunk, one bit and one directory entry of each level."""
    value = 0
    for depth, (n, chunks, bitmap, rank) in enumerate(_levels(block)):
        if not 0 <= i < n:
            raise IndexError(i)
        value |= block[chunks + i] << (_CHUNK * depth)
        if not block[bitmap + i // 8] >> (i % 8) & 1:
            return value
        group = i // _GROUP
        first = bitmap + group * _GROUP // 8
        before = int.from_bytes(block[first : bitmap + i // 8], "little").bit_count() + (block[bitmap + i // 8] & ((1 << (i % 8)) - 1)).bit_count()
        i = struct.unpack_from("<I", block, rank + 4 * group)[0] + before
    raise ValueError("the last level goes on")


def dac_decode(block: bytes) -> np.ndarray:
    """All ids of a block."""
    out, where = np.zeros(0, np.uint32), None
    for depth, (n, chunks, bitmap, _) in enumerate(_levels(block)):
        level = np.frombuffer(block, np.uint8, n, chunks).astype(np.uint32) << (_CHUNK * depth)
        goes_on = np.unpackbits(np.frombuffer(block, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)
        if where is None:
            out, where = level, np.flatnonzero(goes_on)
        else:
            out[where] |= level
            where = where[goes_on]
    return out


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Write the ids of every document, each followed by end_id, in ascending doc_id order.

    A null text is empty. A null doc_id comes first; rows of equal doc_id stand in an order of their texts' hash. Whole texts
    are written, however long: a block grows with its last document. An empty table makes a file without blocks.
    Only doc_id and text are read, so other columns don't matter. Each partition of the range sort becomes a run of
    blocks numbered by the partition.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), struct.pack("<I", end_id)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, ends, packed, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            body = dac_encode(np.frombuffer(b"".join(packed), "<u4"))
            return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "before": [before], "n_ids": [held], "doc_ids": [ids], "ends": [ends], "codes": [body]}, schema=_ARROW_BLOCK)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packed.append(encoder.encode(text) + end)
                held += len(packed[-1]) // 4
                ids.append(doc_id)
                ends.append(held)
                if held >= BLOCK_IDS:
                    yield block()
                    number, before = number + 1, before + held
                    ids, ends, packed, held = [], [], [], 0
        if ids:
            yield block()

    sorted_rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    sorted_rows.mapInArrow(blocks, _BLOCK).write.parquet(path)


_BLOCK = "part int, block int, before long, n_ids long, doc_ids array<long>, ends array<long>, codes binary"
_ARROW_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary())])


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of a file, and how many ids stand before each of its parts."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each written partition
    return blocks, totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of long).

    start counts the ids of all documents before it. Its base for each partition is a running sum over one row per
    written partition; within a partition the file has it.
    """
    blocks, base = _blocks(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = dac_decode(row["codes"]).astype("<u4"), 0
                starts = [0, *row["ends"][:-1]]
                out = {"doc_id": row["doc_ids"], "part": [row["part"]] * len(starts), "local": [row["before"] + x for x in starts], "n_tokens": [e - s for s, e in zip(starts, row["ends"], strict=True)], "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, row["ends"], strict=True)]}
                arrow = [("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                if with_ids:
                    out["ids"] = [ids[s:e].tolist() for s, e in zip(starts, row["ends"], strict=True)]
                    arrow.append(("ids", pa.list_(pa.int64())))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(arrow))

    schema = "doc_id long, part int, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = blocks.select("part", "before", "doc_ids", "ends", "codes").mapInArrow(documents, schema)
    kept = ["ids"] if with_ids else []
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *kept)


def read_tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place and id for each row of places (place long), which counts from 0 over all ids of the file; null where it has none.

    Places find their block by the stretches of BLOCK_IDS that it covers. A block travels once to the places in it, and
    each id is read through the directories; no block is decoded. Other columns of places don't matter.
    """
    blocks, base = _blocks(spark, path)
    first = F.col("base") + F.col("before")
    index = blocks.select("part", "block", "before", "n_ids").join(F.broadcast(base), "part").select("part", "block", first.alias("first"), (first + F.col("n_ids")).alias("end"))
    stretches = index.withColumn("stretch", F.explode(F.sequence(F.expr(f"first div {BLOCK_IDS}"), F.expr(f"(end - 1) div {BLOCK_IDS}"))))
    asked = places.select("place").filter("place >= 0").distinct().withColumn("stretch", F.expr(f"place div {BLOCK_IDS}"))
    inside = asked.join(stretches, "stretch").filter((F.col("place") >= F.col("first")) & (F.col("place") < F.col("end")))
    grouped = inside.groupBy("part", "block").agg(F.first("first").alias("first"), F.collect_list("place").alias("places"))  # at most a block's ids

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"place": row["places"], "id": [dac_get(row["codes"], x - row["first"]) for x in row["places"]]}, schema=pa.schema([("place", pa.int64()), ("id", pa.int64())]))

    found = grouped.join(blocks.select("part", "block", "codes"), ["part", "block"]).select("first", "places", "codes").mapInArrow(look, "place long, id long")
    return places.select("place").join(found, "place", "left")
