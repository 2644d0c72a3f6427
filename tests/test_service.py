"""The engine's plugs, filters, caches and settings on a small index."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.operators import compose, index, manuals
from tessera.plans import cli, service
from tessera.sources import readers
from tessera.streaming import ingest

MANUALS = [
    ("pump.md", 0, "# Pump book\n## Cleaning the filter\nRinse the filter with water once a month and let it dry before use.\n## Storage of parts\nKeep all the parts of the pump in a dry and dark room in winter.\n", "manual"),
    ("note.md", 1, "# Notes\n## Filter remarks\nThe filter of the older pump is blue and has to be rinsed with water too.\n", "note"),
]


@pytest.fixture(scope="module")
def idx(spark):
    providers.register("llm", "echo", lambda: lambda prompts: [f"{p.splitlines()[-1]} see [C1]" for p in prompts])
    providers.register("cross-encoder", "length", lambda: lambda q, t: [float(len(x)) for x in t])
    return service.build(spark.createDataFrame(MANUALS, "source_doc string, doc_ord long, text string, doc_type string"), service.Settings())


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, question string, context_unit string, f_safety boolean, f_doc_type string")


def test_model_and_cache(spark, idx):
    settings = service.Settings(llm="echo")
    first = asked(spark, [(1, "How is the filter rinsed?", None, None, None), (2, " how is the filter rinsed?", None, None, None)])
    out = service.ask(first, idx, settings).cache()
    rows = {r.query_id: r for r in out.collect()}
    assert rows[1].answer.endswith("Question: How is the filter rinsed? see [C1]")
    assert (rows[1].cache_hit, rows[2].cache_hit, rows[2].answer) == (False, True, rows[1].answer)
    assert len(rows[1].citations) == 1
    entries = service.cache_entries(first, out, idx, settings).cache()
    assert [r.query_id for r in entries.collect()] == [1]
    later = asked(spark, [(11, "How is the filter rinsed??", None, None, None), (12, "How is the filter rinsed?", None, None, "note"), (13, "Where are parts kept in winter?", "", None, "")])
    again = {r.query_id: r for r in service.ask(later, idx, settings, cache=entries).collect()}
    assert {q: r.cache_hit for q, r in again.items()} == {11: True, 12: False, 13: False}
    assert again[11].answer == rows[1].answer
    assert "note" in again[12].citations[0].source_doc
    assert service._scope(first, idx, settings) is not None and idx.version != ""


def test_search_rerankers_and_trace(spark, idx):
    questions = asked(spark, [(1, "filter water", None, None, None), (2, "filter water", None, None, "note"), (3, "filter water", None, None, "none")])
    questions = questions.select("query_id", "question", F.col("question").alias("retrieval_query"), F.col("context_unit").alias("f_unit"), "f_safety", "f_doc_type")
    settings = service.Settings(reranker="cross-encoder", cross_encoder="length", mode="bm25")
    ranked = service.search(questions, idx, settings).cache()
    assert all(r.rerank == len(r.text) for r in ranked.collect())
    assert {r.query_id: r.n for r in ranked.groupBy("query_id").agg(F.count("id").alias("n")).collect()} == {1: 2, 2: 1}
    traced = {r.query_id: r for r in service.trace(ranked, settings).collect()}
    assert (traced[1].mode, traced[1].pool_size, set(traced[1].rerank)) == ("bm25", 2, {r.id for r in ranked.where("query_id = 1").collect()})
    plain = service.search(questions, idx, service.Settings(reranker="none", mode="bm25")).where("query_id = 2").collect()
    assert [(r["rank"], r.doc_type) for r in plain] == [(1, "note")]


def test_settings():
    got = service.Settings.from_env({"TESSERA_TOP_K": "3", "TESSERA_GUARDRAIL": "no", "TESSERA_DIVERSITY": "0.5", "TESSERA_MODE": "dense", "OTHER": "x"}, mode="bm25")
    assert (got.top_k, got.guardrail, got.diversity, got.mode) == (3, False, 0.5, "bm25")
    for wrong in ({"mode": "x"}, {"reranker": "x"}, {"reranker": "cross-encoder"}, {"llm": "unknown"}):
        with pytest.raises(ValueError):
            service.Settings(**wrong)


def test_ids_dimension_events_json(spark):
    chunks = spark.createDataFrame([("a", 1, "old"), ("a", 5, "new"), ("b", 2, None)], "id string, chunk_ord long, text string")
    assert sorted(map(tuple, index.by_id(chunks, spark.createDataFrame([("a",), ("a",), ("z",)], "id string")).collect())) == [("a", 5, "new")]
    assert index.dimension(None, lambda: [0.0] * 7) == 7
    assert index.dimension(spark.createDataFrame([(None,), ([1.0, 2.0],)], "embedding array<float>"), lambda: []) == 2
    answers = spark.createDataFrame([(1, "two  words"), (2, None)], "query_id long, answer string")
    got = [(r.query_id, r.event, r.data) for r in compose.events(answers).orderBy("query_id", "seq").collect()]
    assert got == [(1, "meta", ""), (1, "token", "two  "), (1, "token", "words"), (1, "done", ""), (2, "meta", ""), (2, "done", "")]
    assert sorted(map(str, readers.from_json(readers.to_json(chunks), chunks.schema).collect())) == sorted(map(str, chunks.collect()))


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "pump.md").write_text(MANUALS[0][2])
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "1", "question": "How is the filter rinsed with water?", "expected_section": "Cleaning the filter"}) + "\n")
    code = cli.main(["--golden", str(tmp_path / "g.jsonl"), "--corpus", str(tmp_path / "m"), "--mode", "bm25", "--index-dir", str(tmp_path / "i")], spark)
    said = json.loads(capsys.readouterr().out)
    assert (said["mode"], said["items"], said["recall"]) == ("bm25", 1, 1.0)
    assert code == (0 if said["passed"] else 1)
    assert index.load_snapshot(spark, str(tmp_path / "i")).count() == 2


def test_manuals_are_whole_files(spark, tmp_path):
    for name, text in (("b.md", "one\ntwo\n"), ("a.md", "three"), ("c.txt", "no")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, readers.manuals(spark, str(tmp_path)).collect())) == [("a.md", 0, "three"), ("b.md", 1, "one\ntwo\n")]


def test_documents_are_ingested_as_chunks(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "chunks")
    schema = "source_doc string, doc_ord long, text string"

    def arrive(text):
        spark.createDataFrame([("pump.md", 0, text)], schema).write.mode("append").parquet(source)
        prepare = lambda docs: manuals.chunks(manuals.sections(docs, {}))
        ingest.ingest(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "checkpoint"), prepare=prepare).awaitTermination()
        return {r.id: (r.version, r.text) for r in ingest.latest(spark.read.parquet(table)).collect()}

    first = arrive(MANUALS[0][2])
    assert {i: version for i, (version, _) in first.items()} == {"pump:cleaning-the-filter:sec": 0, "pump:storage-of-parts:sec": 0}
    second = arrive(MANUALS[0][2].replace("winter", "summer"))
    assert {i: version for i, (version, _) in second.items()} == {"pump:cleaning-the-filter:sec": 0, "pump:storage-of-parts:sec": 1}
    assert "summer" in second["pump:storage-of-parts:sec"][1]
