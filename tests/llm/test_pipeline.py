import collections

import corpus_pipeline


def test_stages_keep_clean_documents(spark, tmp_path):
    shared = "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    docs = [(i, f"plain text number {i} " + " ".join(f"word{i}x{k}" for k in range(30)), "en", "s", 9) for i in range(150)]
    docs += [(200 + i, "you vilething you vilething " + " ".join(f"t{i}x{k}" for k in range(30)), "en", "s", 9) for i in range(60)]
    docs += [(300, docs[0][1] + " more", "en", "s", 9), (301, docs[0][1], "en", "s", 9), (301, docs[0][1], "en", "s", 9), (302, "start " + shared + " end", "en", "s", 9), (303, "mail ab@c.example.com now", "en", "s", 24), (304, None, "en", "s", 0), (305, "", "en", "s", 0), (None, "no id here", "en", "s", 9)]
    labels = [(i, 1, int(200 <= i < 300)) for i in range(250)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, shared)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(collections.Counter(r.doc_id for r in df.collect()))
    clean = set(range(150)) | {302, 303, 304, 305, None, 300, 301}
    assert set(seen[0]) == clean and seen[0][301] == 2
    assert set(seen[1]) == clean - {300, 301} and set(seen[1].values()) == {1}
    assert set(seen[2]) == set(seen[1]) - {302}
    assert seen[3] == seen[2]
    changed = df.filter("doc_id = 303").collect()[0]
    assert "ab@c" not in changed.text and changed.n_chars == len(changed.text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
