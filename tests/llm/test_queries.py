"""The queries of the operators and the stages of the pipeline, on a small folder of tables, against their contracts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cellarium.llm import queries

WORDS = [f"word{i}" for i in range(300)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    base = tmp_path_factory.mktemp("tables")
    passages = [" ".join(rnd.sample(WORDS, 14)) for _ in range(6)]
    docs = []
    for i in range(120):
        text = " ".join(rnd.choices(WORDS, k=rnd.randint(3, 60)))
        text = f"{text} vile rude nasty vile rude nasty" if i % 5 == 0 else f"{text} {passages[i % 6]} end" if i % 7 == 0 else text
        docs.append((i, text, ("en", "de", None)[i % 3], "src", len(text)))
    docs += [(200 + i, docs[1][1] + " more", "en", "src", 7) for i in range(3)] + [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "mail a.b@example.com now", "en", "s", 1), (1, docs[1][1], "en", "src", 1), (303, "longer " * 5000, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([*enumerate(passages), (90, "word1 word2"), (91, None), (92, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    pages = [(i, f"http://h{i % 3}.example.{'net/fr' if i % 2 else 'com/en'}/{i}", f"<html><body><nav>menu</nav><article><p>own &amp; {i}</p></article></body></html>") for i in range(20)] + [(20, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    rng = np.random.default_rng(9)
    spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)] + [(150, None)], "vec_id long, embedding array<float>").write.parquet(f"{base}/embeddings.parquet")
    return str(base), docs


def crc_fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_neighbours_query(spark, folder):
    df = queries.op1_nearest_neighbours(spark, folder[0])
    assert types(df) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").filter("embedding IS NOT NULL").collect()}
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got.keys() == {0, 50, 100}
    hits = 0
    for q in got:
        cosine = {i: float(v @ vectors[q] / np.linalg.norm(v) / np.linalg.norm(vectors[q])) for i, v in vectors.items() if i != q}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        assert [k for k, _ in got[q]] == [1, 2, 3, 4, 5]
        hits += len(set(best) & {i for _, i in got[q]})
    assert hits >= 13


def test_pseudonym_query(spark, folder):
    rows = {r.doc_id: r for r in queries.op2_pii_pseudonyms(spark, folder[0]).collect()}
    assert rows[302].kinds == "email" and rows[302].n_replaced == 1 and re.fullmatch(r"mail [a-z]\.[a-z]@example\.com now", rows[302].text) and "a.b@" not in rows[302].text
    assert rows[300].text is None and all(rows[i].text == t for i, t, *_ in folder[1] if i not in (302,))


def test_packing_query(spark, folder):
    df = queries.op3_best_fit_packing(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    filled = {}
    for r in df.orderBy("sequence_id", "offset").collect():
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    total = sum(filled.values())
    assert max(filled.values()) <= 2048 and len(filled) <= -(-total // 2048) + 1


def test_decontamination_query(spark, folder):
    df = queries.op4_decontamination(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder[0]}/{name}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op4_decontamination"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    by_id = {r.doc_id: r for r in df.collect()}
    assert by_id[7].contaminated and by_id[7].items_sha256 == hashlib.sha256(str(7 % 6).encode()).hexdigest()


def test_toxicity_query(spark, folder):
    df = queries.op6_toxicity(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = df.collect()
    assert len(rows) == len(folder[1]) and all(r.held_out == (crc_fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_token_query(spark, folder):
    df = queries.op7_token_file(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    at = 0
    for r in df.orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens


def test_page_queries(spark, folder):
    rows = {r.page_id: r for r in queries.op8_html_text(spark, folder[0]).collect()}
    assert {i: r.text for i, r in rows.items()} == {i: f"own & {i}" for i in range(20)} | {20: ""} and all(r.n_chars == len(r.text) for r in rows.values())
    urls = {r.page_id: r for r in queries.op5_url_filter(spark, folder[0]).collect()}
    assert (urls[1].rule, urls[1].verdict, urls[0].rule, urls[20].host, urls[20].verdict) == ("net/fr/", "block", "example.com/en/", "", "allow")


def test_language_query(spark, folder):
    df = queries.op9_language(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    rows = df.collect()
    assert len(rows) == len(folder[1]) and all(r.held_out == (crc_fold(r.doc_id, 4) == 2) for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (300, 301)} == {"und"} and {r.lang_pred for r in rows} <= {"en", "de", "und"}


def test_near_duplicate_query(spark, folder):
    df = queries.op10_near_duplicates(spark, folder[0])
    assert types(df) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    rows = {r.doc_id: r for r in df.collect()}
    assert {rows[i].component_id for i in (1, 200, 201, 202)} in ({1}, {1, 200}) and rows[300].n_shingles == 0 and all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_stages_on_odd_tables(spark, folder):
    """Every stage on an empty table, and on columns whose names it uses itself."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("doc_id % 4 = 1 OR doc_id >= 300")
    odd = docs.selectExpr("*", "'s' AS score", "1 AS predicted", "'p' AS pii", "'h' AS _hash", "7 AS uid", "8 AS component")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
        if name == "packing":
            continue
        out = stage(spark, odd, folder[0])
        assert out.columns == odd.columns
        rows = out.collect()
        assert {(r.score, r.predicted, r.pii, r["_hash"], r.uid, r.component) for r in rows} == {("s", 1, "p", "h", 7, 8)}
        assert {300, 301, 302} <= {r.doc_id for r in rows}
