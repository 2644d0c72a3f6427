"""Language identification by prediction by partial matching.

For each language a byte context tree of order ORDER is built from its training
sample and frozen. A symbol is coded in its longest known context: there with
n_s / (n + d) if the context has seen it (n: the context's count, d: its
distinct symbols), else with the escape d / (n + d) and then in the next shorter context
(PPM method C, Moffat 1990, without exclusions); below order 0 all symbols are equally likely.
The exact code length of the whole text under each language's tree is summed;
the shortest wins, and the score is the winner's posterior probability under equal priors.

Bytes are coded in 64 symbols: ASCII letters without case, and the bytes that are most
frequent in the sample; the rest share the last symbol, which costs the same
further bits in every language and so is left out.

The sample: of each language, the training rows whose hash is lowest, expected to be at
most SAMPLE_ROWS (a documented bound: it's a classifier). Everything else covers all rows.

Defined cases: a null text or one without a letter is `und` with score 0; without training rows
every text is. Ties go to the language first in order. Repeated rows and null ids are
predicted like others. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.shared import table

ORDER, SAMPLE_ROWS, UNKNOWN = 3, 300, "und"
_SYMBOLS = 64


def sample_grams(train: DataFrame, symbols: np.ndarray | None = None) -> DataFrame:
    """train: (lang, text). (lang, gram, n): counts of ORDER + 1 coded symbols; without symbols, of single lower-cased bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in kernels.blocks(batch.column(1)):
                by_lang = defaultdict(list)
                for i in range(block.last - block.first):
                    data = kernels.LOWER[block.data[block.offsets[i] : block.offsets[i + 1]]]
                    by_lang[langs[block.first + i]].append(data if symbols is None else grams(symbols[data]))
                for lang, parts in by_lang.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), type=pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grams(symbols: np.ndarray) -> np.ndarray:
    """For each place, the symbols ORDER back to here as one number; before the text's start stands the last symbol."""
    padded = np.concatenate([np.full(ORDER, _SYMBOLS - 1, dtype=np.uint8), symbols])
    out = np.zeros(len(symbols), dtype=np.int32)
    for k in range(ORDER + 1):
        out = out << 6 | padded[k : k + len(symbols)]
    return out


class ContextTrees:
    """The frozen trees of all languages as tables of code lengths in bits."""

    def __init__(self, counts: dict[str, dict[int, int]], symbols: np.ndarray):
        self.langs, self.symbols = sorted(counts), symbols
        known = sorted({g for c in counts.values() for g in c})
        m, n = _SYMBOLS**ORDER, len(self.langs)
        self.place = np.zeros(_SYMBOLS ** (ORDER + 1), dtype=np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.full = np.zeros((len(known) + 1, n))
        self.escape = np.zeros((m, n))
        self.shorter = np.empty((m, n))
        grams_ = np.array(known, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            own = np.zeros(_SYMBOLS ** (ORDER + 1), dtype=np.int64)
            own[list(counts[lang])] = list(counts[lang].values())
            bits = np.full(_SYMBOLS, math.log2(_SYMBOLS))
            for order in range(ORDER + 1):
                table_ = own.reshape(-1, _SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, _SYMBOLS)
                total, distinct = table_.sum(axis=1), (table_ > 0).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                    if order < ORDER:
                        here = -np.log2(table_ / (total + distinct)[:, None])
                        below = np.tile(bits.reshape(-1, _SYMBOLS), (_SYMBOLS if order else 1, 1))
                        bits = np.where(table_ > 0, here, escape[:, None] + below)
                    else:
                        context = grams_ // _SYMBOLS
                        c = own[grams_]
                        longest = -np.log2(c / (total + distinct)[context])
                        self.full[1:, k] = np.where(c > 0, longest, escape[context] + bits.reshape(-1)[grams_ % m])
            self.escape[:, k] = escape
            self.shorter[:, k] = bits.reshape(-1)
        self.full, self.escape, self.shorter = (x.astype(np.float32) for x in (self.full, self.escape, self.shorter))

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        m = _SYMBOLS**ORDER
        for block in kernels.blocks(texts):
            if not len(block.data):
                continue
            n = block.last - block.first
            s = self.symbols[kernels.LOWER[block.data]]
            gram = np.zeros(len(s), dtype=np.int32)
            begin = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
            for back in range(ORDER, -1, -1):
                shifted = np.full(len(s), _SYMBOLS - 1, dtype=np.uint8)
                shifted[back:] = s[: len(s) - back]
                for ahead in range(back):
                    at = begin + ahead
                    at = at[at < len(s)]
                    shifted[at] = np.where(kernels.owners(at, block.offsets) == kernels.owners(at - ahead, block.offsets), _SYMBOLS - 1, shifted[at])
                gram = gram << 6 | shifted
            place = self.place[gram]
            bits = self.full[place]
            new = np.flatnonzero(place == 0)
            bits[new] = self.escape[gram[new] >> 6] + self.shorter[gram[new] & (m - 1)]
            owner = np.flatnonzero(block.offsets[:-1] < block.offsets[1:])
            out[block.first + owner[: len(begin)]] = np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
            assert len(owner) == len(begin) <= n
        return out


def fit(df: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> ContextTrees:
    """Trees of the training rows with a language and a text."""
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key_col).alias("key"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return ContextTrees({}, np.zeros(256, dtype=np.uint8))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, -(2**63) + min(2**64 - 1, 2**64 * sample_rows // n))])
    chosen = rows.where(F.col("key") <= limit[F.col("lang")]).select("lang", "text")
    if {r.lang for r in chosen.select("lang").distinct().collect()} != set(sizes):
        chosen = rows.select("lang", "text")
    frequent: dict[int, int] = defaultdict(int)
    for r in sample_grams(chosen).collect():
        frequent[r.gram] += r.n
    symbols = np.full(256, _SYMBOLS - 1, dtype=np.uint8)
    for s, b in enumerate(sorted(frequent, key=lambda b: (-frequent[b], b))[: _SYMBOLS - 1]):
        symbols[b] = s
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    for r in sample_grams(chosen, symbols).collect():
        counts[r.lang][r.gram] = r.n
    return ContextTrees(counts, symbols)


def predict(df: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    langs = [*trees.langs, UNKNOWN]
    sent = df.sparkSession.sparkContext.broadcast(trees)  # tables of 64 ** ORDER rows a language and one of 64 ** (ORDER + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = sent.value
        for batch in batches:
            spoken = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            if frozen.langs:
                bits = frozen.code_lengths(batch.column(1))
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
            else:
                best, score, spoken = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=bool)
            best = np.where(spoken, best, len(langs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[i] for i in best.tolist()], type=pa.string()), pa.array(np.where(spoken, score, 0.0))], ["id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("spoken"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose crc32(doc_id as text) mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    done = predict(docs, fit(docs, F.coalesce(~held_out, F.lit(True))))
    return done.select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
