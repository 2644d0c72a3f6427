import math
import re
import tracemalloc
from collections import Counter

import pyarrow as pa

from tessera.llm.quality_rules import COUNTS, DELTA, MAX_REPEAT, RISKS, RULES, STEPS, certified, choose_cutoff, op7_quality_rules, stage_quality, text_counts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {t for t, n in Counter(triples).items() if n > 1}
    covered = {i + k for i, t in enumerate(triples) if t in often for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)]


def test_counts(odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    got = text_counts(pa.array(texts))
    assert [[int(got[c][i]) for c in COUNTS[:6]] for i in range(len(texts))] == [brute(t) for t in texts]
    assert len(text_counts(pa.array([], type=pa.string()))["n_words"]) == 0


def test_query(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_quality_rules(spark, sf).collect():
        want = brute(docs[r.doc_id])
        assert [r[c] for c in COUNTS[:5]] == want[:5]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def binomial_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_certificates_are_exact():
    for n in (1, 100, 700, 2000):
        for k in (0, 1, 3):
            assert certified(k, n, 0.01, 0.05) == (binomial_cdf(k, n, 0.01) <= 0.05)
    assert not certified(0, 0, 0.01, 0.05)


def features(text):
    """Each rule's ratio over the end of its grid, from its definition."""
    text = text or ""
    n = dict(zip(COUNTS[:6], brute(text), strict=True))
    n |= {"n_letters": len(re.findall("[A-Za-z]", text)), "n_upper": len(re.findall("[A-Z]", text)), "n_marks": len(re.findall("[!?;:]", text))}
    return [n[over] / n[under] / top if n[under] else 0.0 for over, under, top in RULES.values()]


def brute_kept(docs, good):
    """docs: {id: (lang, text)}; good: ids. Cutoffs by trying all, from the most lenient on; few labels: one stratum."""
    strata = {lang: [features(docs[i][1]) for i in good if docs[i][0] == lang] for lang in {docs[i][0] for i in good}}

    def none_rejected(n, alpha, level):
        return (1 - alpha) ** n <= level

    alone = {x for x, own in strata.items() if any(none_rejected(len(own), a, DELTA * share / (len(strata) + 1)) for a, share in RISKS.values())}
    few = [f for x, own in strata.items() if x not in alone for f in own]
    tests = len(alone) + bool(set(strata) - alone)
    cut = {}
    for x, own in strata.items():
        own = own if x in alone else few
        cut[x] = []
        for r, rule in enumerate(RULES):
            alpha, share = RISKS[rule]
            best = math.inf
            for k in range(STEPS, -1, -1):
                rejected = sum(math.ceil(f[r] * STEPS) > k for f in own)
                if rejected >= alpha * len(own) or binomial_cdf(rejected, len(own), alpha) > DELTA * share / tests:
                    break
                best = k
            cut[x].append(best)
    out = {}
    for i, (lang, text) in docs.items():
        n = brute(text)
        base = n[0] < 50 or 100 * n[4] > MAX_REPEAT * n[0]
        out[i] = not base and not any(min(STEPS + 1, math.ceil(f * STEPS)) > c for f, c in zip(features(text), cut.get(lang, [math.inf] * len(RULES)), strict=True))
    return out, cut


def test_kept_matches_brute_force(spark):
    """On the table of 1,000 documents a cutoff is certified, and turns documents away that the base lets pass."""
    from tessera.llm.quality_rules import op7_quality_rules

    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: (d.lang, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [x.doc_id for x in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    want, cut = brute_kept(docs, good)
    got = op7_quality_rules(spark, sf).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert any(c <= STEPS for own in cut.values() for c in own)
    assert sum(not r.kept and not r.base_failed for r in got) > 0


def test_strata_of_null_and_blank_differ(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, words, None) for i in range(700)] + [(1000 + i, words + (" #" * 30 if i < 200 else ""), "") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    marked = docs.unionByName(spark.createDataFrame([(5000, words + " #" * 30, None), (5001, words + " #" * 30, "")], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in stage_quality(spark, marked, str(tmp_path)).collect()}
    assert 5000 not in kept
    assert 5001 in kept


def test_strictest_certified_cutoff():
    above = [1000] * 10 + [0] * (STEPS - 9)
    assert choose_cutoff(above, 5000, 0.01, 0.01) == 10
    assert choose_cutoff([1000] * (STEPS + 1), 5000, 0.01, 0.01) == STEPS + 1
    assert choose_cutoff([0] * (STEPS + 1), 10, 0.01, 0.01) == STEPS + 1


def test_stage(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = stage_quality(spark, odd_docs, str(tmp_path))
    assert kept.columns == odd_docs.columns
    for r in kept.collect():
        n = brute(r.text)
        assert n[0] >= 50
        assert 100 * n[4] <= 50 * n[0]
    assert stage_quality(spark, no_docs, str(tmp_path)).count() == 0


def test_memory_goes_by_blocks():
    """4 MB of texts: working memory is that of one block, so that two workers fit beside an executor's heap."""
    texts = pa.array([f"some words of text {k} and others\n" * 300 for k in range(400)])
    text_counts(texts)
    tracemalloc.start()
    try:
        text_counts(texts)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
