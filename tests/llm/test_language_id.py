import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER
from tessera.llm.language_id import ORDER, ContextTrees, fit, grams, op3_language_id, predict


def brute_bits(train, text, symbols):
    """Code length by walking the contexts of each symbol, from the definition."""
    code = lambda t: [63] * ORDER + [int(symbols[LOWER[b]]) for b in t.encode()]
    seen = Counter()
    for t in train:
        c = code(t)
        for i in range(ORDER, len(c)):
            for order in range(ORDER + 1):
                seen[tuple(c[i - order : i]), c[i]] += 1
    contexts = {}
    for (ctx, s), n in seen.items():
        contexts.setdefault(ctx, {})[s] = n
    c, bits = code(text), 0.0
    for i in range(ORDER, len(c)):
        for order in range(ORDER, -2, -1):
            if order < 0:
                bits += math.log2(64)
                break
            own = contexts.get(tuple(c[i - order : i]), {})
            total, distinct = sum(own.values()), len(own)
            if c[i] in own:
                bits -= math.log2(own[c[i]] / (total + distinct))
                break
            if own:
                bits -= math.log2(distinct / (total + distinct))
    return bits


def test_code_lengths_are_exact():
    train = {"a": ["the cat sat on the mat. The hat", "a rat"], "b": ["le chat était là, été", "où est-il ?"]}
    texts = ["the chat", "", "été à la mer", "zzz\x00qq漢", None, "a", "le"]
    symbols = np.full(256, 63, dtype=np.uint8)
    for s, b in enumerate(sorted({int(LOWER[x]) for t in train.values() for y in t for x in y.encode()})[:63]):
        symbols[b] = s
    counts = {lang: dict(Counter(g for t in ts for g in grams(symbols[LOWER[np.frombuffer(t.encode(), dtype=np.uint8)]]).tolist())) for lang, ts in train.items()}
    got = ContextTrees(counts, symbols).code_lengths(pa.array(texts))
    for i, t in enumerate(texts):
        for k, lang in enumerate(sorted(train)):
            assert got[i, k] == pytest.approx(brute_bits(train[lang], t or "", symbols), rel=1e-5, abs=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark, odd_docs, no_docs):
    got = predict(odd_docs, fit(odd_docs, F.lit(True)))
    rows = {r.id: r for r in got.collect()}
    assert got.count() == odd_docs.count()
    assert {rows[i].lang_pred for i in (0, 1, 2)} == {"und"}
    assert rows[9].lang_pred in ("en", "fr")
    assert predict(no_docs, fit(no_docs, F.lit(True))).count() == 0
    assert {r.lang_pred for r in predict(odd_docs, fit(no_docs, F.lit(True))).collect()} == {"und"}
