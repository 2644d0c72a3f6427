import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from tessera.llm.mixing import WEIGHTS, document_levels, leaf_budgets, op1_mixing, oracle, plan_mix, apply_mix, stage_mixing


def test_query_matches_sql(spark, sf):
    assert same(op1_mixing(spark, sf), oracle(), sf) == 200


def fill(budget, children):
    """children: (name, cap, weight). Water-filling by repeated rounds, exact fractions rounded by running sums."""
    children = [c for c in children if c[1] > 0 and c[2] > 0]
    full = {}
    while True:
        rest, open_ = budget - sum(full.values()), [c for c in children if c[0] not in full]
        total = sum(w for _, _, w in open_)
        over = [c for c in open_ if c[1] * total <= rest * c[2]]
        if not over:
            break
        full.update({n: c for n, c, _ in over})
    done, out = 0, dict(full)
    for n, _, w in sorted(open_):
        out[n] = rest * (done + w) // total - rest * done // total
        done += w
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(0, 50)), min_size=1, max_size=8, unique_by=lambda t: t[:2]), st.integers(0, 250), st.integers(0, 3), st.integers(1, 5))
def test_budgets_go_to_siblings_first(spark, leaves, budget, w, v):
    weights = [(("a",), w), (("*", "x"), v), (("b", "y"), 3)]
    weigh = lambda path: next((x for p, x in weights if len(p) == len(path) and all(a in ("*", b) for a, b in zip(p, path))), 1)
    caps = {leaf[:2]: leaf[2] * (weigh(leaf[:2]) > 0) for leaf in leaves}
    top = {d: sum(c for p, c in caps.items() if p[0] == d) * (weigh((d,)) > 0) for d in "ab"}
    upper = fill(min(budget, sum(top.values())), [(d, c, weigh((d,))) for d, c in top.items()])
    want = {}
    for d in "ab":
        want |= fill(upper.get(d, 0), [(p, c, weigh(p)) for p, c in caps.items() if p[0] == d])
    df = spark.createDataFrame([(a, b, t, 1) for a, b, t in leaves], "g string, h string, tokens long, docs long")
    got = {(r.g, r.h): r.budget for r in leaf_budgets(df, ["g", "h"], weights, budget=budget, max_epochs=1).collect()}
    assert got == {p: want.get(p, 0) for p in caps}


def test_prefixes_fill_each_leaf_whatever_the_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    levels = document_levels()
    results = []
    for bucket in (1, 7, 1000):
        plan = plan_mix(docs, levels, WEIGHTS, bucket=bucket, percent=45)
        results.append(sorted((r.doc_id, r._n, r._full, r._taken) for r in apply_mix(docs, plan, levels).select("doc_id", "_n", "_full", "_taken").collect()))
    assert results[0] == results[1] == results[2]
    assert sum(n * f + t for _, n, f, t in results[0]) == sum(n for _, n, _, _ in results[0]) * 45 // 100


def test_stage_and_odd_texts(spark, odd_docs, no_docs):
    kept = stage_mixing(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken = defaultdict(int)
    for r in kept.collect():
        assert texts[r.doc_id].startswith(r.text)
        assert r.n_chars == len(r.text)
        taken["all"] += len(words(r.text))
    total = sum(len(words(r.text)) for r in odd_docs.collect())
    assert taken["all"] == total * 90 // 100
    assert stage_mixing(spark, no_docs, "").count() == 0
    assert plan_mix(no_docs, {"a": F.col("lang")}, []).count() == 0
