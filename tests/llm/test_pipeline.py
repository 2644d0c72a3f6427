from collections import defaultdict

import corpus_pipeline


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    pieces = defaultdict(list)
    for r in got.collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert 20 < len(pieces) < docs.count()
    for own in pieces.values():
        assert sum(n for _, n, _ in own) == own[0][2]


def test_empty(spark, sf, no_docs, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_texts_and_names(spark, odd_docs, tmp_path):
    """Null, blank and long texts, repeats, ties and clashing names go through all stages; columns that stages don't own keep their values."""
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = " ".join(f"plain{i}" for i in range(90))
    texts = [(100, plain), (101, "été 漢字 " + " ".join(f"other{i}" for i in range(70))), (102, plain + " end"), (None, plain), (100, plain), (103, " ".join(f"w{i}" for i in range(30_000))), (104, None), (105, "")]
    rest = [c for c in odd_docs.columns if c not in ("doc_id", "text")]
    more = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", *[{"lang": "'en' lang", "source": "cast(null as string) source", "n_chars": "cast(length(text) as bigint) n_chars", "a": "1L a"}.get(c, f"'mine' {c}") for c in rest])
    docs = odd_docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd_docs.columns
        assert {r.asDict()[c] for r in docs.collect() for c in ("kept", "_q", "_n", "_k", "_doc", "_id", "row")} <= {"mine"}
    left = {r.doc_id for r in docs.collect()}
    assert {101, 103} <= left <= {100, 101, 103}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(left)


def test_one_id_with_two_texts(spark):
    """Of (1, A), (2, A), (2, B) only (2, A) goes."""
    from tessera.llm.simhash_groups import stage_simhash

    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in stage_simhash(spark, docs, "").collect()) == [(1, "a"), (2, "b")]
