import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import SEGMENTS, op9_packing, pack, place, vocabulary_path


def check(pieces, ids):
    """pieces: rows; ids: list of (doc_id, ids with end). Every id once, sequences gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in ids.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], dtype="<u4").tobytes())
            assert p.doc_tokens == len(own)
            at += p.length
        assert at == len(own)
    padding = 0
    for part in by_sequence.values():
        at = 0
        for p in sorted(part, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        assert len(part) <= SEGMENTS
        padding += 2048 - at if at & (at - 1) else 0
    return padding


def test_query_round_trip(spark, sf):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1] for d in docs}
    padding = check(op9_packing(spark, sf).collect(), ids)
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_odd_texts(spark, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    once = odd_docs.dropDuplicates(["doc_id"])
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1] for d in once.collect()}
    check(pack(once, vocabulary_path()).collect(), ids)
    assert pack(no_docs, vocabulary_path()).count() == 0
    twice = pack(odd_docs, vocabulary_path()).where("doc_id = 5")
    assert sum(p.length for p in twice.collect()) == 3 * len(ids[5])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=40), st.integers(1, 128), st.integers(1, 6), st.integers(1, 128))
def test_limits_hold(examples, size, segments, loss):
    tokens, bears = np.array([e[0] for e in examples], dtype=np.int64), np.array([min(e) for e in examples], dtype=np.int64)
    seen = defaultdict(list)
    for pieces in place(tokens, bears, (size, segments, loss)):
        assert sum(n for _, _, n in pieces) <= size
        assert len(pieces) <= segments
        assert sum(max(0, s + n - max(s, int(tokens[i] - bears[i]))) for i, s, n in pieces) <= loss
        for i, s, n in pieces:
            seen[i].append((s, n))
    for i, t in enumerate(tokens):
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == t


def demands(pieces, tokens, bears):
    loss = sum(max(0, s + n - max(s, int(tokens[i] - bears[i]))) for i, s, n in pieces)
    return sum(n for _, _, n in pieces), len(pieces), loss


def test_choice_by_dot_product():
    """Examples that all fit whole: each next one has the largest product of demands and room, worked out anew."""
    rng = np.random.default_rng(7)
    tokens = rng.integers(20, 200, 60)
    bears = (tokens * rng.random(60)).astype(np.int64)
    limits = (1000, 20, 500)
    first = place(tokens, bears, limits)[0]
    room, left = list(limits), set(range(60))
    for k, (i, s, n) in enumerate(first):
        need = {j: (int(tokens[j]), 1, int(bears[j])) for j in left}
        fits = [j for j in left if all(x <= r for x, r in zip((need[j][0], 1, need[j][2]), (room[0], room[1], room[2]), strict=True))]
        if not fits or room[1] == 1:
            break
        best = max(sum(x * r / m / m for x, r, m in zip(need[j], room, limits, strict=True)) for j in fits)
        assert (s, n) == (0, tokens[i])
        assert sum(x * r / m / m for x, r, m in zip(need[i], room, limits, strict=True)) == pytest.approx(best)
        room = [r - x for r, x in zip(room, need[i], strict=True)]
        left.discard(i)
    assert k >= 3


def test_each_limit_binds():
    tokens = np.full(200, 100)
    by_tokens = place(tokens, np.zeros(200, dtype=int), (1000, 50, 900))
    assert all(demands(p, tokens, tokens * 0)[0] == 1000 for p in by_tokens)
    by_segments = place(tokens, np.zeros(200, dtype=int), (1000, 4, 900))
    assert all(len(p) <= 4 for p in by_segments)
    half = np.array([100, 0] * 100)
    by_loss = place(tokens, half, (1000, 50, 500))
    assert [demands(p, tokens, half) for p in by_loss] == [(1000, 10, 500)] * 20
    heavy = place(tokens, tokens, (1000, 50, 500))
    assert all(demands(p, tokens, tokens)[2] <= 500 for p in heavy)


def test_long_examples_keep_their_proportion():
    for pieces in place(np.array([20_480]), np.array([14_336]), (2048, 64, 1640)):
        total, _, loss = demands(pieces, np.array([20_480]), np.array([14_336]))
        assert abs(loss - 0.7 * total) <= 10


def test_words_are_tokenised_as_texts():
    from tessera.llm.packing import tokenizer_of

    whole = Tokenizer.from_file(vocabulary_path())
    texts = ["Don't we'LL''s I've it's 'm 'D x'S'", "a1b22c333 #$%&'()*+,-./:;<=>?@[\\]^_`{|}~ --a''s", "<|endoftext|> x<|startoftext|>y <|x|>", "\x01\x7f a\x02b", "\u00c9t\u00e9 na\u00efve\u00a0x e\u0301 \u212b 12\u00bd", "", " \t", "Word WORD word\x0bword\x0cword"]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("abAB'sStTrRevlLmd019 -_.,<|>\u00e9\u00df"), 60)) for _ in range(300)]
    got = tokenizer_of(vocabulary_path())([t.encode() for t in texts])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block", [1, 50, 1 << 21])
def test_blocks_are_tokenised_as_texts(monkeypatch, block):
    """Contractions, digits, capitals, every white space, and words that aren't plain among plain ones, whatever the blocks' size."""
    from tessera.llm import packing

    monkeypatch.setattr(packing, "_BLOCK", block)
    whole, by_blocks = Tokenizer.from_file(vocabulary_path()), packing.WordTokenizer(vocabulary_path())
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abA'''sStTrRevVlLmdD019 -_.,<|>\u00e9\u00c0\u00de\u00df\u00ff\t\n\r\v\f "), rng.integers(0, 80))) for _ in range(300)]
    odd = ["\u00d7", "\u20ac x", "<|endoftext|>", "<|ENDOFTEXT|>", "e\u0301", "\u0130", "J\u030c", "\u03a3\u03a3 a", "\x1c", "\u00a0"]
    texts[::5] = [t[:20] + odd[k % len(odd)] + t[20:] for k, t in enumerate(texts[::5])]
    texts += ["", " ", "'", "'s", "'ll's", "x'", ""]
    got = by_blocks([t.encode() for t in texts])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert by_blocks([]) == [] and by_blocks([b""]) == [b""]


@pytest.mark.parametrize("first", ["", "\u201cx\u201d "])
def test_work_grows_with_parts_not_with_words(first):
    """20,280 distinct words of 38 parts: calls made in Python go with the parts and not with the words."""
    import sys

    from tessera.llm.packing import WordTokenizer

    letters = ["".join(chr(97 + (k * m) % 26) for m in (1, 3, 7, 11)) for k in range(26)]
    words = [f"{a}-{b}.{k}" for a in letters for b in letters for k in range(30)]
    assert len(set(words)) > 20_000
    tokenizer, calls = WordTokenizer(vocabulary_path()), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        tokenizer([(first + " ".join(words)).encode()])
    finally:
        sys.setprofile(None)
    assert calls[0] < 2_000


def test_limits_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        place(np.array([1]), np.array([1]), (0, 1, 1))
