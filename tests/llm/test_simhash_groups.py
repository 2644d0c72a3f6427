import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm.components import components
from tessera.llm.hamming import forest
from tessera.llm.simhash_groups import embed, manhattan, near_groups, op8_simhash_groups, stage_simhash, with_fingerprints


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """rows: (id, fp). The least id reachable, by id."""
    root = {fp: fp for _, fp in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = list(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, fp in rows:
        least[find(fp)] = min(i, least.get(find(fp), i))
    return sorted((i, fp, least[find(fp)]) for i, fp in rows)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_groups([(d.doc_id, brute_print(d.text)) for d in docs])
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op8_simhash_groups(spark, sf).collect())
    assert got == want
    assert max(Counter(c for _, _, c in got).values()) > 1


def test_odd_texts(spark, odd_docs, no_docs):
    got = sorted((r.id, r.fp & (2**64 - 1)) for r in with_fingerprints(odd_docs).collect())
    assert got == sorted((d.doc_id, brute_print(d.text)) for d in odd_docs.collect())
    assert with_fingerprints(no_docs).count() == 0
    kept = stage_simhash(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 3, 4, 7, 8, 9, 10}
    assert stage_simhash(spark, no_docs, "").count() == 0


def test_chains_within_the_radius_are_all_found(spark):
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 2**64, 120, dtype=np.uint64)]
    for v in values[:40]:
        for _ in range(6):
            v ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            values.append(v)
    rows = list(enumerate(values))
    signed = [(i, v - 2**64 if v >> 63 else v) for i, v in rows]
    got = near_groups(spark.createDataFrame(signed, "id long, fp long")).collect()
    assert sorted((r.id, r.fp & (2**64 - 1), r.component) for r in got) == brute_groups(rows)


def test_lower_bound_and_large_cells():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    y[::2] = x[::2] ^ np.uint64(0b1011)
    assert (manhattan(x, y) <= np.bitwise_count(x ^ y)).all()
    assert (np.bitwise_count(embed(x)) == np.bitwise_count(x)).all()
    base = np.uint64(12345)
    near = np.array([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 40, 300)], dtype=np.uint64)
    i, j = forest(np.zeros(300, dtype=np.int64), near, 4)
    assert len(i) == 299
    assert set(j) == {0}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (None, 3)], [(i, i + 1) for i in range(30)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert set(got) == nodes
    for a, b in edges:
        if a in nodes and b in nodes:
            assert got[a] == got[b]
    assert all(got[n] == min(m for m in nodes if got[m] == got[n]) for n in nodes)


def brute_kept(rows):
    """rows: (id, text) of distinct ids. The ids that stay, by Jaccard similarity of five-word shingles alone."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] != root[j] and small >= 0.8 * large:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (small + large - both) - 1e-9:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if r == high else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_stage_finds_shingle_similarity(spark, sf):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(7)
    for k in range(30):
        words = [f"d{k}x{int(x)}" for x in rng.integers(0, 10**5, 120)]
        rows += [(10_000 + 2 * k, " ".join(words))]
        words[40] = words[80] = "other"
        rows += [(10_001 + 2 * k, " ".join(words[k % 5 :]))]
    kept = {r.doc_id for r in stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == brute_kept(rows)
    assert not any(i > 10_000 and i % 2 for i in kept)


def test_stage_candidates_are_by_simhash(spark):
    """Fingerprints within the radius are candidates without a common cell of least shingles; with one, those within the wide radius are; texts without words are none."""
    from tessera.llm import simhash_groups

    rows = [(1, 0b0000, [1, 2]), (2, 0b1111, [3, 4]), (3, 0xFF << 40, [5, 2]), (4, 0x7FFFFFFF << 20, [1, 6]), (5, 0, []), (6, 0b0000, [7])]
    prints = spark.createDataFrame(rows, "fp long, print long, cells array<long>")
    found = {(r.node, r.root) for r in components(simhash_groups.shingle_candidates(prints)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (6, 1)}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, " ")], "doc_id long, text string")
    got = {r.id: r.print for r in simhash_groups.shingle_prints(docs).collect()}
    assert got[1] == got[2] != 0 == got[3]
