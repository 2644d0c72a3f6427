import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.elias_fano import BigramTrie, EliasFano, Levels
from tessera.llm.lm_scoring import STRENGTH, op10_lm_scoring, score


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, strength=STRENGTH):
    """rows: (doc_id, text, train). (doc_id, n_tokens, n_known, N, base, score) of each."""
    single, double = Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = tokens(text)
            single.update(t)
            double.update(zip(["<s>", *t], t))
    n, v = sum(single.values()), len(single)
    p1 = lambda w: (single[w] + 0.1) / (n + 0.1 * (v + 1))
    before = lambda w: single[None] if w == "<s>" else single[w]
    for i, text, _ in rows:
        t = tokens(text)
        s = sum(math.log10((double[a, b] + strength * p1(b)) / (before(a) + strength)) for a, b in zip(["<s>", *t], t))
        yield i, len(t), sum(single[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), s


def compare(got, want):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = sorted((w[0] is None, *w) for w in want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-4, abs=2e-3)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op10_lm_scoring(spark, sf).collect()
    compare(got, brute([(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode()) % 10 != 0) for d in docs]))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_many_shards_and_frequent_words(spark, odd_docs, no_docs):
    rows = [(d.doc_id, d.text, d.doc_id % 3 != 0) for d in odd_docs.collect()]
    compare(score(odd_docs, F.col("doc_id") % 3 != 0, shard=900).collect(), brute(rows))
    assert score(no_docs, F.lit(True)).count() == 0


def test_no_training_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b a"), (1, None)], "doc_id long, text string")
    got = score(df, F.lit(None).cast("boolean")).collect()
    assert sorted((r.doc_id is None, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(False, 1, 0, 0), (True, 4, 0, 0)]


@pytest.mark.parametrize(("n", "top"), [(1, 1), (5, 10), (1000, 2**64 - 1), (3000, 4000), (2000, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    sequence = EliasFano(values, Levels())
    assert (sequence[np.arange(len(values))] == values).all()
    assert (sequence.find(values) == np.arange(len(values))).all()
    other = np.setdiff1d(rng.integers(0, top, n, dtype=np.uint64, endpoint=True), values)
    assert (sequence.find(other) == -1).all()
    assert (sequence.find(values, start=np.full(len(values), 1)) == np.where(np.arange(len(values)) < 1, -1, np.arange(len(values)))).all()


def test_trie_with_empty_levels():
    none = np.zeros(0, dtype=np.int64)
    trie = BigramTrie(none.astype(np.uint64), none, none, none.astype(np.uint32), none, none.astype(float), 1.0)
    assert (trie.word(np.array([3], dtype=np.uint64)) == -1).all()
    assert len(trie.pair(none, none.astype(np.uint64))) == 0
