import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.sketches import K, containment, distinct_shingles, edited_and_next, merge, op6_sketches, resemblance, sketch


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows: (doc_id, text). doc_id, n_chars, hash of the edited text, exact likeness to it and to the next document."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 2
        edited = t[: len(t) - n] + u[:n]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, u)


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:], abs=0.2)
    if len(got) > 50:
        assert sum(abs(g[3] - w[3]) for g, w in zip(got, want)) / len(got) < 0.04


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op6_sketches(spark, sf).collect()
    compare(got, brute([(d.doc_id, d.text) for d in docs]))
    assert not any(re.search("Python|Arrow|Pandas", line) for line in op6_sketches(spark, sf)._jdf.queryExecution().toString().splitlines())


@pytest.mark.parametrize("run", [1, 2, 100])
def test_odd_texts(spark, odd_docs, no_docs, run):
    take = lambda df: df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    compare(edited_and_next(take(odd_docs), run).collect(), brute([(d.doc_id, d.text) for d in odd_docs.collect()]))
    assert edited_and_next(take(no_docs), run).count() == 0
    rows = [(None, "a b"), (10**12, "c d e f g h"), (-5, "x" * 7), (3, "y"), (None, "b")]
    compare(edited_and_next(spark.createDataFrame(rows, "doc_id long, text string"), run).collect(), brute(rows))


def test_estimates_and_merging(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 3000))
    s = lambda c: sketch(F.col(c))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(s("a").alias("a"), s("b").alias("b"), s("c").alias("c"))
    r = df.select(resemblance(F.col("a"), F.col("b")), distinct_shingles(F.col("a")), containment(F.col("b"), F.col("a")), containment(F.col("a"), F.col("b")), F.size(merge(F.col("a"), F.col("b")))).first()
    assert r[0] == pytest.approx(0.5, abs=0.15)
    assert r[1] == pytest.approx(2996, rel=0.3)
    assert r[2] == pytest.approx(1, abs=0.25)
    assert r[3] == pytest.approx(0.5, abs=0.2)
    assert r[4] == K
