import bisect
import collections
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellarium.llm.common import shared_folder
from cellarium.llm.packing import match, pack_documents
from cellarium.llm import tokens
from cellarium.llm.tokens import dac_decode, dac_encode, dac_get, read_token_file, read_tokens_at, splits_at_blanks, vocabulary_path, word_encoder, write_token_file

TEXTS = ["Hello there, World!", "", None, "été Straße ŒUVRE", "a b c\x1cd", "it's don't WE'LL", "x" * 5000, "12 345 ½ ² Σίσυφος ΟΔΟΣ", "<|endoftext|> mid<|ENDOFTEXT|>dle <|startoftext|>", "é i̇ İstanbul", "…—“quoted”… ...!!! %%% a.b.c.", "日本語 テスト 한국어", "😀😀 ok", "\n\n\t\r\nline\n", "don’t " * 900]
SCHEMA = "doc_id long, text string, piece string, length string, uid string, part string"


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def rows(extra=()):
    return [(i, t, "p", "l", "u", "q") for i, t in [*enumerate(TEXTS), (None, "null id"), (3, "again"), (3, "again"), *extra]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(text):
    encoder = word_encoder(vocabulary_path())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_on_odd_texts(text):
    encoder = word_encoder(vocabulary_path())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1200))
def test_codes_round_trip_and_random_access(ids):
    block = dac_encode(np.array(ids, np.uint32))
    assert dac_decode(block).tolist() == ids
    assert [dac_get(block, i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        dac_get(block, len(ids))


def test_token_file_round_trip(spark):
    path = shared_folder(spark)
    write_token_file(spark.createDataFrame(rows(), SCHEMA).repartition(3), path, vocabulary_path())
    got = read_token_file(spark, path, with_ids=True).orderBy("start").collect()
    whole = word_encoder(vocabulary_path()).whole
    want = sorted(((-1 if i is None else i), (whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows())
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [i for i, _ in want]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens


def test_token_file_of_an_empty_table(spark):
    path = shared_folder(spark)
    write_token_file(spark.createDataFrame([], SCHEMA), path, vocabulary_path())
    assert read_token_file(spark, path).count() == 0


def best_fit_decreasing(sizes, capacity):
    free, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(free, size)
        if at < len(free):
            gap = free.pop(at)
        else:
            gap, n = capacity, n + 1
        if gap > size:
            bisect.insort(free, gap - size)
    return n


@pytest.mark.parametrize("seed", range(40))
def test_match_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 50, 200])
    sizes = [rnd.randint(1, rnd.choice([capacity, capacity // 3 + 1])) for _ in range(rnd.randint(0, 300))]
    counts, placed, seqs = collections.Counter(sizes), collections.Counter(), collections.defaultdict(list)
    for size, first, last, sequence, at, each in match(counts, capacity):
        placed[size] += last - first
        for k in range(last - first):
            seqs[sequence + k // each].append((at + k % each * size, size))
    assert placed == counts
    for parts in seqs.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= capacity
    assert len(seqs) == best_fit_decreasing(sizes, capacity)


def test_packing_places_every_piece(spark):
    given_rows = rows([(100 + i, "word " * (i % 40)) for i in range(200)])
    got = pack_documents(spark.createDataFrame(given_rows, SCHEMA).repartition(3), vocabulary_path(), capacity=64).collect()
    whole, want = word_encoder(vocabulary_path()).whole, []
    for i, t, *_ in given_rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(-1 if i is None else i, k, at, len(ids[at : at + 64]), crc(ids[at : at + 64])) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 64
    assert len(seqs) == best_fit_decreasing([r.length for r in got], 64)


def test_packing_of_an_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), vocabulary_path()).count() == 0


def test_token_file_of_many_blocks_and_ids_by_place(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choices(["alpha", "beta", "Straße", "x1"], k=rnd.choice([0, 5, 40, 300])))) for i in range(40)]
    path = shared_folder(spark)
    write_token_file(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path, vocabulary_path())
    assert spark.read.parquet(path).count() > 20
    library = word_encoder(vocabulary_path()).whole
    ids = [x for _, t in docs for x in [*library.encode(t, add_special_tokens=False).ids, 1]]
    rows = read_token_file(spark, path, with_ids=True).orderBy("doc_id").collect()
    assert [x for r in rows for x in r.ids] == ids and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    wanted = [*range(0, len(ids), 7), 0, len(ids) - 1, len(ids), -1, None]
    got = [(r.place, r.id) for r in read_tokens_at(spark, path, spark.createDataFrame([(p, "k") for p in wanted], "place long, stretch string")).collect()]
    assert collections.Counter(got) == collections.Counter((p, ids[p] if p is not None and 0 <= p < len(ids) else None) for p in wanted)


def test_other_vocabularies_take_the_whole_path(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    other = Tokenizer(models.WordLevel({"A": 0, "b c": 1, "?": 2}, unk_token="?"))
    other.normalizer, other.pre_tokenizer = normalizers.NFC(), pre_tokenizers.Split(",", "removed")
    path = str(tmp_path / "other.json")
    other.save(path)
    assert not splits_at_blanks(path) and splits_at_blanks(vocabulary_path())
    assert list(np.frombuffer(tokens.WordEncoder(path).encode("A,b c,a"), "<u4")) == [0, 1, 2]
