"""Parsing, chunking, ranking and answers on small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import bm25, compose, evaluate, fusion, index, manuals, understand

UNITS = {"T100": r"\bT\s?-?100\b", "K7": r"\bK\s?-?7\b"}
MANUAL = """# Boiler T-100 handbook
## Parts
A part that was hyph-
enated, with a line of text.
Table: Things
| Code | Cause | Fix |
|------|-------|-----|
| E 04 | low | refill |
| E04, E-05 | high | drain |
page 3 of 9
## Lockout rules
### Details
> **WARNING**: hot
Text of the details that is long enough to stay.
## Steps
1. one
2. two
note
3. three
4. four
5. five
"""


@pytest.fixture(scope="module")
def parsed():
    return manuals.parse("boiler.md", 0, MANUAL, UNITS)


def test_parse(parsed):
    assert [(s["title"], s["parent_ord"], s["safety"]) for s in parsed] == [("Parts", None, False), ("Lockout rules", None, True), ("Details", 1, True), ("Steps", None, False)]
    assert parsed[0]["text"].startswith("A part that was hyphenated")
    assert parsed[0]["unit_model"] == "T100"
    table = parsed[0]["tables"][0]
    assert table["caption"] == "Things"
    assert {f["code"]: f["row_idx"] for f in table["fault_rows"]} == {"E04": 1, "E-05": 1}
    assert parsed[2]["warnings"] == ["WARNING: hot"]
    assert manuals.parse("empty.md", 0, None, UNITS) == []


def test_chunks(spark):
    docs = spark.createDataFrame([("boiler.md", 0, MANUAL), ("none.md", 1, None)], "source_doc string, doc_ord long, text string")
    got = {r.id: r for r in manuals.chunks(manuals.sections(docs, UNITS)).collect()}
    assert set(got) == {"boiler:parts:sec", "boiler:parts:table", "boiler:lockout-rules:details:sec", "boiler:steps:step-1-4:steps", "boiler:steps:step-5-5:steps"}
    assert got["boiler:steps:step-1-4:steps"].text.endswith("2. two note\n3. three\n4. four")
    assert got["boiler:parts:table"].code_anchors == ["E-05", "E04"]
    assert got["boiler:lockout-rules:details:sec"].safety


def test_paragraph_groups_overlap(spark):
    df = spark.createDataFrame([("aaaa\n\nbbbb\n\ncccc",), ("short",), ("x" * 30,)], "x string")
    got = [r[0] for r in df.select(manuals.paragraph_groups(F.col("x"), 9)).collect()]
    assert got == [["aaaa\n\nbbbb", "bbbb\n\ncccc"], ["short"], ["x" * 30]]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "pump pump valve"), (2, "valve"), (3, "")], "id long, text string")
    asked = spark.createDataFrame([(9, "pump pump")], "query_id long, question string")
    got = bm25.scores(docs, asked, "id").collect()
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    avgdl = (3 + 1 + 1) / 3
    assert [(r.id, round(r.bm25, 9)) for r in got] == [(1, round(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 9))]


def test_fusion_and_blend(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "query_id long, id long, rank int")
    fused = fusion.reciprocal_ranks([ranks([(1, 10, 1), (1, 11, 2)]), ranks([(1, 11, 1), (1, 12, 2)])], "id")
    rows = {r.id: r for r in fused.collect()}
    assert [i for i, r in sorted(rows.items(), key=lambda x: x[1]["rank"])] == [11, 10, 12]
    assert rows[11].rrf == pytest.approx(1 / 62 + 1 / 61)
    pool = fused.withColumn("rerank", F.when(F.col("id") == 12, 5.0).otherwise(0.0))
    final = {r.id: (r.final, r.final_rank) for r in fusion.blend(pool, "id").collect()}
    assert final[12] == (pytest.approx(2 / 62), 2)
    assert fusion.blend(pool, "id", top_k=2).count() == 2


def test_diversity(spark):
    pool = spark.createDataFrame([(1, 1, 1, [1.0, 0.0]), (1, 2, 2, [1.0, 0.01]), (1, 3, 3, [0.7, 0.7])], "query_id long, id long, rank int, embedding array<double>")
    got = {r.id: r.mmr_rank for r in fusion.diversify(pool, "id", "query_id", 3, lam=0.3).collect()}
    assert got == {1: 1, 3: 2, 2: 3}


def test_topics(spark):
    cases = ["recover R32", "how much R32 charge does it carry", "top up the R513A", "panel live, relief valve", None, "hello"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [r[0] for r in df.select(t.safety_topics(F.col("x"))).collect()] == [["refrigerant"], [], ["refrigerant"], ["energized-electrical", "pressurized"], [], []]


def test_understanding(spark):
    df = spark.createDataFrame([(1, "Heat pump shows e-04 and R32", None), (2, "K7 is icing up", None)], "query_id long, question string, c string")
    codes = spark.createDataFrame([("E04",)], "code string")
    units = {"T100": (UNITS["T100"], ["heat pump"]), "K7": (UNITS["K7"], ["chiller"])}
    got = {r.query_id: r for r in understand.analyze(df, codes, units, context="c").collect()}
    assert (got[1].codes, got[1].unit_model, got[1].intent) == (["E04"], "T100", "fault_lookup")
    assert got[2].expansions == ["coil frost", "icing", "defrost", "evaporator"]
    assert got[2].unit_model == "K7"


def test_difference_and_reuse(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    embedded = []

    def embed(rows):
        out = rows.withColumn("embedding", F.array(F.length("text").cast("float")))
        embedded.append(out.count())
        return out

    first = index.reindex(frame([(1, "a"), (2, "b")]), None, embed, "d")
    again = index.reindex(frame([(1, "a"), (2, "bb"), (3, "c")]), first, embed, "d")
    assert embedded == [2, 2]
    assert sorted((r.id, r.embedding[0]) for r in again.collect()) == [(1, 1.0), (2, 2.0), (3, 1.0)]
    states = {r.id: r.state for r in index.difference(again, first).collect()}
    assert states == {1: "unchanged", 2: "updated", 3: "new"}
    index.reindex(frame([(1, "a")]), first, embed, "other")
    assert embedded[-1] == 1


def test_groundedness(spark):
    cases = [("alpha beta 5", ["alpha beta, 5"]), ("", ["x"]), ("gamma never works here", ["delta"])]
    df = spark.createDataFrame(cases, "a string, c array<string>")
    got = [r[0] for r in df.select(evaluate.groundedness(F.col("a"), F.col("c"))).collect()]
    assert got == [pytest.approx(0.6 * 1 / 2 + 0.4), 0.0, pytest.approx(0.3)]


def test_escalation_message(spark):
    df = spark.createDataFrame([(["gas"], "Safety", "T100"), ([], None, None)], "t array<string>, s string, u string")
    a, b = (r[0] for r in df.select(t.escalation_message(F.col("t"), F.col("s"), F.col("u"))).collect())
    assert 'involves gas for the T100, which' in a
    assert a.endswith('"Safety" in the T100 manual.')
    assert b.endswith("No matching safety section is currently indexed for this unit.")


def test_citation_markers(spark):
    ranked = spark.createDataFrame([(1, i, i, f"text number {i} alpha", f"q{i}") for i in (1, 2, 3)], "query_id long, chunk_ord long, rank int, text string, question string")
    named = spark.createDataFrame([(1, "see [C3] and [C1], [C3]")], "query_id long, answer string")
    assert sorted((r.place, r.chunk_ord) for r in compose.citations(named, ranked).collect()) == [(1, 3), (2, 1)]
