"""Scores of whole texts under a smoothed bigram model learned from the same corpus.

p(w | v) = (c(v, w) + m * p1(w)) / (c(v) + m), with p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)):
Dirichlet smoothing of strength m (MacKay and Peto 1995). Its logarithm is a
term of w and v that needs only what is known of w, less a term of v alone; so one
shuffle by word brings all that either term needs to one place:

1. Words are counted (by 64-bit key), which gives N, V and the words that are too
   frequent for one shard. Those are at most HOT by construction.
2. Each task turns its texts into batches of (word, word before, document) and
   sends one packed row for each batch and shard of words. Frequent words are
   dealt to several shards by the word before. Shards hold about SHARD tokens,
   so more text makes more shards, not larger ones.
3. A shard counts its training tokens, builds its part of the Elias-Fano trie
   in a memory-mapped file, and looks all its tokens up in it.
4. The sums go back to the batch that they came from, packed, and are added up by document.

Defined cases: a null or blank text consists of the end token alone. Without
training tokens every token is unknown. Rows are scored one by one, also where ids repeat or
are null. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.elias_fano import BigramTrie
from tessera.llm.shared import materialise, table

STRENGTH, SHARD, HOT, BATCH = 200.0, 1_500_000, 8192, 1_200_000
_END = kernels.mix(np.array([0x5F5F656E645F5F], dtype=np.uint64))[0]
_PACKED = "shard int, batch long, words binary, word_pairs binary, befores binary, pair_tokens binary, docs binary, train binary, ids binary, tokens binary"
_SCORED = "batch long, docs binary, known binary, base binary, score binary, ids binary, tokens binary, train binary"
_U = np.uint64


def _tokens(block: kernels.Block) -> tuple[np.ndarray, np.ndarray]:
    """Key and document (within the block) of each token in order, the end token last in each document."""
    data = kernels.LOWER[block.data]
    starts, ends = kernels.words(data, block.offsets)
    n = block.last - block.first
    doc = kernels.owners(starts, block.offsets)
    keys, docs = np.full(len(starts) + n, _END, dtype=np.uint64), np.empty(len(starts) + n, dtype=np.int64)
    keys[np.arange(len(starts)) + doc] = kernels.Hasher(data)(starts, ends)
    docs[np.arange(len(starts)) + doc] = doc
    docs[np.cumsum(np.bincount(doc, minlength=n) + 1) - 1] = np.arange(n)
    return keys, docs


def word_counts(texts: DataFrame) -> DataFrame:
    """texts: one string column. (key, n) of each word and the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                held.append(_tokens(block)[0])
                size += len(held[-1])
                if size > 3_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(shards) >> _U(32)).astype(np.int32)


def _deal(docs: DataFrame, shards: int, hot: list[tuple[int, int]]) -> DataFrame:
    """docs: (id, text, train). Packed rows for each batch and shard; the row of a batch with ids holds its documents."""
    hot_keys = np.array(sorted(k & (2**64 - 1) for k, _ in hot), dtype=np.uint64)
    parts = {k & (2**64 - 1): n for k, n in hot}
    hot_parts = np.array([parts[int(k)] for k in hot_keys], dtype=np.uint64)
    # Parts go to shards in turn, so that no shard gets more of them than another by two or more.
    hot_first = np.cumsum(hot_parts, dtype=np.uint64) - hot_parts

    def packed(keys, docs, before, ids, train, number) -> pa.RecordBatch:
        mixed = (before * _U(0x9E3779B1)) & _U(0xFFFFFFFF)
        order = np.argsort((keys & ~_U(0xFFFFFF)) | (mixed >> _U(8)))
        keys, docs, before, mixed = keys[order], docs[order], before[order], mixed[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(keys)))
        key, prior, where = keys[at], before[at].astype(np.uint32), key_shards(keys[at], mixed[at])
        shuffled = np.argsort(where, kind="stable")
        pieces = np.searchsorted(where[shuffled], np.arange(shards + 1))
        doc_of = np.repeat(at[shuffled], length[shuffled])
        inner = np.arange(len(doc_of)) - np.repeat(np.cumsum(length[shuffled]) - length[shuffled], length[shuffled])
        tokens = docs[doc_of + inner].astype(np.uint16)
        key, prior, length = key[shuffled], prior[shuffled], length[shuffled]
        upto = np.concatenate([[0], np.cumsum(length)])
        rows: list[tuple] = []
        flags = np.packbits(train).tobytes()
        for s in range(shards):
            low, high = pieces[s], pieces[s + 1]
            if low == high:
                continue
            k = key[low:high]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            rows.append((s, number, k[first].tobytes(), np.diff(np.append(first, len(k))).astype(np.uint32).tobytes(), prior[low:high].tobytes(), length[low:high].astype(np.uint32).tobytes(), tokens[upto[low] : upto[high]].tobytes(), flags, None, None))
        amounts = np.bincount(docs, minlength=len(train)).astype(np.int64)
        rows.append((number % shards, number, b"", b"", b"", b"", b"", flags, _ids(ids), amounts.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate([pa.int32(), pa.int64(), *[pa.binary()] * 8])], [x.split()[0] for x in _PACKED.split(", ")])

    def key_shards(key, mixed):
        out = _shard_of(key, shards)
        if len(hot_keys):
            place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
            at = np.flatnonzero(hot_keys[place] == key)
            piece = mixed[at] * hot_parts[place[at]] >> _U(32)
            out[at] = ((hot_first[place[at]] + piece) % _U(shards)).astype(np.int32)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list = [[], [], [], [], []]
        size = count = 0

        def flush():
            return packed(*(np.concatenate(h) for h in held[:3]), [i for part in held[3] for i in part], np.concatenate(held[4]), number)

        for batch in batches:
            ids, train = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for block in kernels.blocks(batch.column(1)):
                for low in range(0, block.last - block.first, 30_000):
                    high = min(low + 30_000, block.last - block.first)
                    part = kernels.Block(0, high - low, block.data[block.offsets[low] : block.offsets[high]], block.offsets[low : high + 1] - block.offsets[low])
                    keys, docs = _tokens(part)
                    before = np.empty(len(keys), dtype=np.uint64)
                    before[1:] = keys[:-1] >> _U(32)
                    before[0] = 0
                    before[1:][docs[1:] != docs[:-1]] = 0
                    for h, x in zip(held, (keys, docs + count, before, ids[block.first + low : block.first + high], train[block.first + low : block.first + high]), strict=True):
                        h.append(x)
                    count += high - low
                    size += len(keys)
                    if size > BATCH or count > 30_000:
                        yield flush()
                        held, size, count = [[], [], [], [], []], 0, 0
                        number += 1
        if count:
            yield flush()

    return docs.mapInArrow(run, _PACKED)


def _ids(ids: list) -> bytes:
    """Integer ids with a leading byte for null, 9 bytes each."""
    return b"".join(b"\0" * 9 if i is None else b"\1" + int(i).to_bytes(8, "little", signed=True) for i in ids)


def _score(packed: DataFrame, shards: int, total: int, distinct: int, hot_totals: dict[int, int], strength: float) -> DataFrame:
    """Builds each shard's trie and looks its tokens up: sums by batch and document."""
    scale = total + 0.1 * (distinct + 1)

    def shard(rows: list[dict]) -> Iterator[tuple]:
        full = [r for r in rows if r["words"]]
        for r in rows:
            if r["ids"] is not None:
                yield r["batch"], b"", b"", b"", b"", r["ids"], r["tokens"], r["train"]
        if not full:
            return
        read = lambda name, kind: [np.frombuffer(r[name], dtype=kind) for r in full]
        before, length, docs = read("befores", np.uint32), read("pair_tokens", np.uint32), read("docs", np.uint16)
        keys = np.concatenate([np.repeat(w, n) for w, n in zip(read("words", np.uint64), read("word_pairs", np.uint32), strict=True)])
        trained = [np.unpackbits(np.frombuffer(r["train"], dtype=np.uint8)).astype(bool)[d] for r, d in zip(full, docs, strict=True)]
        in_train = np.concatenate([np.add.reduceat(t, np.cumsum(n, dtype=np.int64) - n, dtype=np.int64) for t, n in zip(trained, length, strict=True)])
        before = np.concatenate(before)
        sizes = [len(n) for n in length]
        # Pairs of all batches, equal ones together.
        order = np.lexsort((before, keys))
        keys_o, before_o = keys[order], before[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys_o[1:] != keys_o[:-1]) | (before_o[1:] != before_o[:-1])
        at = np.flatnonzero(new)
        pair_of = np.empty(len(order), dtype=np.int64)
        pair_of[order] = np.cumsum(new) - 1
        pair_key, pair_before = keys_o[at], before_o[at]
        counts = np.add.reduceat(in_train[order], at)
        seen = counts > 0
        word, owner = np.unique(pair_key[seen], return_inverse=True)
        totals = np.bincount(owner, weights=counts[seen], minlength=len(word)).astype(np.int64)
        for i in np.flatnonzero(np.isin(word, hot)):
            totals[i] = hot_totals[int(word[i])]
        trie = BigramTrie(word, totals, owner, pair_before[seen], counts[seen], (totals + 0.1) / scale, strength)
        # Each distinct pair is looked up once.
        place = trie.word(pair_key)
        known = place >= 0
        c = np.zeros(len(place))
        c[known] = trie.totals[place[known]]
        if len(hot):  # a part of a frequent word may have no training token here
            rank = np.minimum(np.searchsorted(hot, pair_key), len(hot) - 1)
            missed = np.flatnonzero(~known & (hot[rank] == pair_key))
            c[missed] = hot_count[rank[missed]]
        score = np.log10(strength * (c + 0.1) / scale) - np.log10(c + strength)
        score[known] = math.log10(strength) + trie.alone[place[known]] - trie.context[place[known]]
        found = np.full(len(place), -1, dtype=np.int64)
        found[known] = trie.pair(place[known], pair_before[known])
        both = found >= 0
        score[both] = trie.smoothed[found[both]] - trie.context[place[both]]
        base = np.log10(c + 0.1)
        done = 0
        for r, d, n, k in zip(full, docs, length, sizes, strict=True):
            token_pair = np.repeat(pair_of[done : done + k], n)
            done += k
            own, inverse = np.unique(d, return_inverse=True)
            s = lambda v: np.bincount(inverse, weights=v[token_pair], minlength=len(own))  # noqa: B023, E731
            yield r["batch"], own.tobytes(), s(c > 0).astype(np.uint32).tobytes(), s(base).tobytes(), s(score).astype(np.float32).tobytes(), None, None, None

    hot = np.array(sorted(hot_totals), dtype=np.uint64)
    hot_count = np.array([hot_totals[int(k)] for k in hot], dtype=np.float64)
    kinds = [pa.int64(), *[pa.binary()] * 7]
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            rows = list(shard(held))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return packed.repartitionById(shards, F.col("shard")).mapInArrow(run, _SCORED)


def _gather(scored: DataFrame, total: int, distinct: int) -> DataFrame:
    """One row for each document of each batch."""
    scale = math.log10(total + 0.1 * (distinct + 1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            top = next(r for r in held if r["ids"] is not None)
            tokens = np.frombuffer(top["tokens"], dtype=np.int64)
            n = len(tokens)
            ids = [int.from_bytes(top["ids"][9 * i + 1 : 9 * i + 9], "little", signed=True) if top["ids"][9 * i] else None for i in range(n)]
            train = np.unpackbits(np.frombuffer(top["train"], dtype=np.uint8))[:n].astype(bool)
            known, base, score = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
            for r in sorted((r for r in held if r["docs"]), key=lambda r: r["known"] + r["base"]):
                d = np.frombuffer(r["docs"], dtype=np.uint16)
                known[d] += np.frombuffer(r["known"], dtype=np.uint32)
                base[d] += np.frombuffer(r["base"], dtype=np.float64)
                score[d] += np.frombuffer(r["score"], dtype=np.float32)
            return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(~train), pa.array(tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base - tokens * scale), pa.array(score)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["batch"] != row["batch"]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, schema)


def score(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH, shard: int = SHARD) -> DataFrame:
    """Scores of all rows under the model of those rows where the column train is true."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts, _ = materialise(word_counts(docs.where("train").select("text")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    most = max(shard // 5, total // HOT)
    hot = [(r.key, r.n) for r in counts.where(F.col("n") > most).limit(HOT).collect()]
    shards = max(1, math.ceil(total / shard))
    dealt = _deal(docs, shards, [(k, math.ceil(n / most)) for k, n in hot])
    scored = _score(dealt, shards, total, distinct, {k & (2**64 - 1): n for k, n in hot}, strength)
    return _gather(scored, total, distinct)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32(doc_id as text) mod 10 isn't 0."""
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
