"""Hard negatives, filter audit and repeated passages against brute force, and their results on odd input."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from cellarium.llm import filter_audit, negatives, queries, substrings

# ---- hard negatives


def codes_of(vector, scale=256):
    return [math.floor(scale * float(x)) for x in vector]


def brute_negatives(rows, is_anchor, k=5, low=80, high=100):
    """rows: distinct (vec_id, label, embedding)."""
    good = [(i, label, codes_of(v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, c in good:
        if not is_anchor(i):
            continue
        others = [(sum(a * b for a, b in zip(c, d, strict=True)), j, m) for j, m, d in good if j != i and len(d) == len(c)]
        first = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1]))[:k]
        for p, j, _ in first([x for x in others if x[2] == label]):
            fits = [x for x in others if x[2] != label and low * p <= 100 * x[0] <= high * p]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(first(fits), 1)]
    return sorted(out)


def negatives_of(spark, rows, kind="double", **settings):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumnsRenamed({})
    odd = df.selectExpr("*", "'x' AS rank", "1 AS uid", "2 AS score", "'p' AS planes", "true AS anchor")
    from pyspark.sql import functions as F

    found = negatives.hard_negatives(odd, F.col("vec_id") % 4 == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("spread", [1.0, 0.02, 40.0])
def test_hard_negatives_equal_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 20)
    monkeypatch.setattr(negatives, "TILE", (7, 32))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 9))
    rows = [(i, i % 3, (spread * (centres[i % 6] + 0.4 * rng.normal(size=9))).tolist()) for i in range(240)]
    rows += [(1000 + i, i % 3, rows[4 * i][2]) for i in range(20)]  # ties
    rows += [(2000, None, rows[0][2]), (2004, 1, None), (2008, 1, [1.0, None]), (2012, 1, [float("nan")] * 9), (2016, 1, [float("inf")] * 9), (None, 1, rows[0][2])]
    rows += [(2020, 1, []), (2024, 2, []), (2028, 1, [1.0, 2.0]), (2029, 1, [1.0, 2.0]), (2031, 0, [1.0, 1.6]), (2032, 1, [0.0] * 9)]
    got = negatives_of(spark, [*rows, rows[3], rows[4], rows[4]])
    assert got == brute_negatives(rows, lambda i: i % 4 == 0) and len(got) > 50


def test_planes_drop_candidates_early(spark):
    """Products with a plane are formed for few of all pairs once the intervals tell, and the result is that of whole products."""
    rng = np.random.default_rng(2)
    codes = np.floor(256 * (x := rng.normal(size=(4000, 32))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    rows = negatives.Planes(negatives.slice_bits(codes, 9), 32, 9)
    assert (rows.values() == codes).all()
    best = negatives.Best(np.full((10, 1), -(1 << 62)), np.full((10, 1), (1 << 63) - 1), 5)
    done = sum(negatives.match_tile(codes[:10], rows[t], np.ones((10, len(rows[t])), bool), best, np.arange(10), np.arange(4000)[t]) for t in negatives._tiles(4000, 500))
    want = np.sort(codes[:10] @ codes.T, axis=1)[:, :-6:-1]
    assert (best.score.reshape(10, 5) == want).all()
    assert done < 0.85 * 9 * 40000


def test_hard_negatives_bounds(spark):
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(0, 1, [1.0])]) == []
    assert negatives_of(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 0, [-1.0])]) == []  # a positive below zero admits nothing
    assert negatives_of(spark, [(0, 1, [1.0]), (1, 1, [0.0]), (2, 0, [0.0]), (3, 0, [0.5])]) == [(0, 1, 1, 2, 0, 0)]
    assert negatives_of(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.8]), (3, 0, [0.79]), (5, 0, [1.01]), (6, 2, [1.0])], negatives=1) == [(0, 1, 1, 6, 65536, 65536)]
    with pytest.raises(ValueError, match="too large"):
        negatives_of(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


# ---- filter audit

LETTERS = "ABCDE"


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        facts.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations(LETTERS)):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                failing = sum(letter in f[1] for f in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_of(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'p' AS part", "1 AS fp", "2 AS n", "3 AS mask")
    found = filter_audit.audit(d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "true AS good"))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def audit_docs():
    rnd = random.Random(4)
    docs = []
    for i in range(150):
        text = " ".join(rnd.choice(["one", "Two", "THREE", f"w{rnd.randrange(300)}", "é#", "日本"]) for _ in range(rnd.choice([0, 20, 99, 100, 150])))
        docs.append((i, text, rnd.choice(["en", "de", None, ""])))
    copied = " ".join(f"c{i}" for i in range(120))
    docs += [(1000 - 3 * i, copied, ("en", "de")[i % 2]) for i in range(80)]  # a group that spans ranges
    docs += [(701, docs[5][1], "en"), (2, docs[5][1], "en"), (None, copied, "en"), (None, None, "fr"), (None, None, "fr"), (900, "", None), (901, None, "en"), (1000, copied, "de"), (763, copied, "en"), (763, copied, "en"), (902, "Word " * 60000, "en")]
    return docs


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_audit_equals_brute_force(spark, parts):
    docs = audit_docs()
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(120)] + [(3, 1, 1), (5, None, None), (None, 1, 1), (9999, 1, 1), (1000, 1, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert audit_of(spark, docs, labels) == brute_audit(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audit_of_odd_tables(spark):
    assert audit_of(spark, [], [(1, 1, 1)]) == {}
    one = audit_of(spark, [(1, None, None)], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_counters_add_up(spark):
    docs, labels = audit_docs(), [(i, int(i % 3 == 0), 0) for i in range(120)]
    found = filter_audit.masks(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    halves = filter_audit.counters(found.filter("doc_id % 2 = 0 OR doc_id IS NULL"), known).unionByName(filter_audit.counters(found.filter("doc_id % 2 = 1"), known))
    whole = filter_audit.counters(found, known)
    total = lambda df: sorted(map(tuple, df.groupBy("part", "mask").sum("n", "good", "toxic").collect()))
    assert total(halves) == total(whole)


# ---- repeated passages


def brute_repeats(docs, least=13):
    """A row for each of docs (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - least + 1):
            if i is not None:
                key = tuple(w[k : k + least])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - least + 1):
            if i is not None and first[tuple(w[k : k + least])] < i:
                gone.update(range(k, k + least))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def repeats_of(spark, docs, least=13):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'h' AS held", "1 AS at", "2 AS text_hash", "3 AS h", "4 AS first")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, least).collect()), key=str)


def repeat_docs(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [rnd.choices(vocabulary, k=n) for n in (12, 13, 14, 25, 26, 60)]
    docs = []
    for i in range(120):
        text = rnd.choices(vocabulary, k=rnd.choice([0, 5, 13, 40]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text) + 1)
            text[at:at] = rnd.choice(passages)
        docs.append((rnd.randrange(1000), rnd.choice([" ", "\n", " \t "]).join(text)))
    docs += [(2000 + i, docs[7][1]) for i in range(30)] + [docs[8], docs[8], (3000, None), (3001, ""), (None, docs[9][1]), (3002, "the same " * 30), (3003, "the same " * 40), (3004, "é x  y " * 13), (3005, ("é x  y " * 13).upper())]
    docs += [(4000, " ".join(f"long{i % 7000}" for i in range(60000))), (4001, " ".join(f"long{i}" for i in range(6999, -1, -1)) + " " + " ".join(f"long{i}" for i in range(500)))]
    return docs


@pytest.mark.parametrize("least", [1, 2, 5, 13, 30])
def test_repeats_equal_brute_force(spark, least):
    docs = repeat_docs()
    assert repeats_of(spark, docs, least) == brute_repeats(docs, least)


def test_repeats_of_odd_tables(spark):
    assert repeats_of(spark, []) == []
    assert repeats_of(spark, [(1, None), (None, "a b")]) == [(1, 0, 0, ""), (None, 2, 0, "a b")]
    text = " ".join(map(str, range(20)))
    assert repeats_of(spark, [(5, text), (5, text)]) == [(5, 20, 0, text)] * 2  # one document, as far as its id goes
    assert repeats_of(spark, [(2, text), (1, f"x {text} y")]) == [(1, 22, 0, f"x {text} y"), (2, 20, 20, "")]


def test_repeats_of_rows_with_one_id(spark, monkeypatch):
    """Different texts of one doc_id whose short hashes are equal are still told apart."""
    monkeypatch.setattr(substrings, "_SHORT", 0)
    docs = repeat_docs(9) + [(50, " ".join(f"q{i}" for i in range(n, n + 30))) for n in range(5)] + [(60, " ".join(f"q{i}" for i in range(20)))]
    assert repeats_of(spark, docs) == brute_repeats(docs)


def test_levels_double():
    assert [substrings.levels(n) for n in (1, 2, 13, 50)] == [[1], [1, 2], [7, 13], [25, 50]]


def test_hot_passage_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 10)
    from cellarium.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    passage = " ".join(f"p{i}" for i in range(16))
    docs = [(i, f"a{i} {passage} b{i} c{i}") for i in range(90)]
    assert repeats_of(spark, docs) == brute_repeats(docs)


# ---- the queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(1)
    vectors = [(i, int(i % 10), (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.normal(size=(420, 5)))]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{base}/embeddings.parquet")
    docs = [(i, t, ("en", None)[n % 2]) for n, (i, t) in enumerate(repeat_docs(6))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, docs


def test_hard_negative_query(spark, folder):
    df = queries.op11_hard_negatives(spark, folder[0])
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()]
    assert sorted(map(tuple, df.collect())) == brute_negatives(rows, lambda i: i % 100 == 0)


def test_audit_query(spark, folder):
    df = queries.op12_filter_audit(spark, folder[0])
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")
    want = brute_audit(folder[1], [(i, i % 2, i % 3) for i in range(500)])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()} == want


def test_repeats_query(spark, folder):
    df = queries.op13_substring_dedup(spark, folder[0])
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute_repeats([d[:2] for d in folder[1]])]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
