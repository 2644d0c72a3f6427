"""Quality rules whose cutoffs come from labelled holdouts with a guarantee.

Each rule is a ratio that is higher for worse texts; a text is rejected if one
lies above the rule's cutoff. For each stratum and rule the cutoffs of a fixed
grid are tested from the most lenient on: a cutoff is certified if the exact
binomial test rejects "it turns away more than the rule's alpha of the good texts" at
the rule's share of DELTA / strata. Testing stops at the first cutoff that fails
(fixed-sequence testing needs no further correction), and the last certified one
is used. The shares add up to 1 (Bonferroni). So with probability 1 - DELTA no rule of any stratum turns away more
than its alpha of the good texts. A rule without a certified cutoff rejects nothing.

A stratum with too few good labels to certify anything would be without rules. Such strata
are one stratum together, for which the guarantee holds as a whole. Which ones they are goes by the
numbers of labels alone, not by the texts, so that the tests stay exact.

Defined cases: a null text has no words; a null stratum is a stratum of its
own; a stratum without labels rejects nothing; labels that are null, for
unknown documents or given again differently count as they stand; an empty
table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels
from tessera.llm.shared import fresh_names, materialise, small, table

DELTA, STEPS = 0.05, 50
MIN_WORDS, MAX_REPEAT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks"]
#: Rule: (numerator, denominator, the grid's most lenient cutoff). Values above the grid are as bad as its end.
RULES = {
    "symbols": ("n_symbols", "n_words", 1.0),
    "marks": ("n_marks", "n_words", 1.0),
    "upper": ("n_upper", "n_letters", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "long_words": ("word_chars", "n_words", 20.0),
}
#: Rule: (alpha, share of DELTA). The first has most of the level, so that a stratum of some 300 good labels gets a cutoff.
RISKS = {"symbols": (0.0125, 0.5)} | {r: (0.005, 0.1) for r in ("marks", "upper", "dup_lines", "repeats", "long_words")}
_SYMBOLS, _UPPER, _LETTER, _MARKS = (np.zeros(256, dtype=np.int64) for _ in range(4))
_SYMBOLS[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = 1
_LETTER[97:123] = 1
_MARKS[list(b"!?;:")] = 1


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text: n_dup_lines and n_repeat_words compare hashes of 64 bits of lines and word triples within the text."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in COUNTS}
    for block in kernels.blocks(texts):
        data, offsets, n = block.data, block.offsets, block.last - block.first
        got: dict[str, np.ndarray] = {}
        starts, ends = kernels.words(data, offsets)
        doc = kernels.owners(starts, offsets)
        got["n_words"] = np.bincount(doc, minlength=n)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        got["word_chars"] = kernels.sums(heads[ends] - heads[starts], doc, n)
        for k, of in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARKS)):
            upto = np.concatenate([[0], np.cumsum(of[data])])
            got[k] = upto[offsets[1:]] - upto[offsets[:-1]]
        hashed = kernels.Hasher(data)
        low, high, owner = kernels.lines(data, offsets)
        spoken = np.searchsorted(starts, high) > np.searchsorted(starts, low)
        low, high, owner = low[spoken], high[spoken], owner[spoken]
        got["n_lines"] = np.bincount(owner, minlength=n)
        salt = kernels.mix(np.arange(1, n + 1, dtype=np.uint64))
        got["n_dup_lines"] = np.bincount(owner[kernels.earlier(kernels.mix(hashed(low, high) ^ salt[owner]))], minlength=n)
        h = hashed(starts, ends)
        inner = np.flatnonzero(doc[:-2] == doc[2:]) if len(h) > 2 else np.zeros(0, dtype=np.int64)
        triple = kernels.mix(kernels.mix(kernels.mix(h[inner] ^ salt[doc[inner]]) + h[inner + 1]) + h[inner + 2])
        again = inner[kernels.repeated(triple)]
        covered = np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[again + k] = True
        got["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
        for k, v in got.items():
            out[k][block.first : block.last] = v
    return out


def with_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, into: str = "_q") -> DataFrame:
    """The columns keep (all by default) and a struct of the text's COUNTS."""
    keep = df.columns if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[text_col].cast("string").alias("_text"))
    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = text_counts(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(got[c]) for c in COUNTS]], [*names, *COUNTS])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.struct(*COUNTS).alias(into))


def _bin(rule: str, q: str) -> Column:
    """In how many steps of the grid's cutoffs the text's ratio lies above them; cutoff k is k / STEPS of the grid's end."""
    over, under, top = RULES[rule]
    ratio = F.coalesce(F.try_divide(F.col(f"{q}.{over}").cast("double"), F.col(f"{q}.{under}")), F.lit(0.0)) / top
    return F.least(F.greatest(F.ceil(ratio * STEPS), F.lit(0)), F.lit(STEPS + 1)).cast("int")


def _bins(q: str = "_q") -> Column:
    return F.array(*[_bin(r, q) for r in RULES])


def _stratum(value: Column) -> Column:
    """A key of the stratum; null is none of the texts."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def certified(rejected: int, good: int, alpha: float, level: float) -> bool:
    """Whether P(Bin(good, alpha) <= rejected) <= level: the Clopper-Pearson upper bound at that level is alpha or less."""
    if not good or rejected >= good * alpha:
        return False
    p, q = math.log(alpha), math.log1p(-alpha)
    return sum(math.exp(math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * p + (good - k) * q) for k in range(rejected + 1)) <= level


def choose_cutoff(above: list[int], good: int, alpha: float, level: float) -> int:
    """above[k]: the good texts over cutoff k, k up to STEPS. The strictest certified cutoff from the lenient end on; STEPS + 1: none."""
    best = STEPS + 1
    for k in range(STEPS, -1, -1):
        if not certified(above[k], good, alpha, level):
            break
        best = k
    return best


def least_labels(alpha: float, level: float) -> int:
    """The fewest good labels by which a cutoff that turns away none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risks: dict[str, tuple[float, float]] = RISKS, delta: float = DELTA) -> DataFrame:
    """(_stratum, _cut array): for each rule, the bin above which a text of the stratum is rejected.

    counted: doc_id, the stratum's column and _q. labels: doc_id, quality. Only a histogram
    of strata x rules x (STEPS + 2) rows leaves the aggregation.
    """
    good = counted.join(labels.where("quality = 1").select("doc_id"), "doc_id").select(_stratum(F.col(stratum)).alias("s"), F.posexplode(_bins()).alias("rule", "bin"))
    histogram, _ = materialise(good.groupBy("s", "rule", "bin").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = histogram.where("rule = 0").groupBy("s").agg(F.sum("n").alias("labels"))
    alone = F.col("labels") >= min(least_labels(a, delta * share / (sizes.count() + 1)) for a, share in risks.values())
    strata, _ = materialise(sizes.select("s", F.when(alone, F.col("s")).otherwise("few").alias("whole")), "strata")
    tests = strata.select("whole").distinct().count()
    rules = list(RULES)

    def choose(key, rows):
        import pandas as pd

        cut = []
        for r, rule in enumerate(rules):
            mine = rows[rows["rule"] == r]
            by_bin = np.bincount(mine["bin"], weights=mine["n"], minlength=STEPS + 2).astype(np.int64)
            over = by_bin[::-1].cumsum()[::-1]
            alpha, share = risks[rule]
            cut.append(choose_cutoff([int(over[k + 1]) for k in range(STEPS + 1)], int(by_bin.sum()), alpha, delta * share / tests))
        return pd.DataFrame({"whole": [key[0]], "_cut": [cut]})

    chosen = histogram.join(small(strata, 1000), "s").groupBy("whole", "rule", "bin").agg(F.sum("n").alias("n")).groupBy("whole").applyInPandas(choose, "whole string, _cut array<int>")
    return strata.join(chosen, "whole").select(F.col("s").alias("_stratum"), "_cut")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT * F.col(f"{q}.n_words"))


def passing(counted: DataFrame, cut: DataFrame, stratum: str = "lang", q: str = "_q", into: str = "_passes") -> DataFrame:
    """counted with a boolean: whether neither the base nor a cutoff rejects the text."""
    name, bounds = fresh_names(counted, 2)
    cut = small(cut.select(F.col("_stratum").alias(name), F.col("_cut").alias(bounds)), 1000)
    broken = F.coalesce(F.exists(F.zip_with(_bins(q), F.col(bounds), lambda b, c: b > c), lambda x: x), F.lit(False))
    return counted.join(cut, _stratum(counted[stratum]) == F.col(name), "left").withColumn(into, ~base_failed(q) & ~broken).drop(name, bounds)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    counted, _ = materialise(with_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]), "counts")
    cut, _ = materialise(cutoffs(counted, table(spark, sf_dir, "labels")), "cutoffs")
    done = passing(counted, cut)
    return done.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"), F.col("_passes").alias("kept"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass; the texts are counted a second time rather than shuffled."""
    counted, _ = materialise(with_counts(docs, keep=["doc_id", "lang"]), "counts")
    cut, _ = materialise(cutoffs(counted, table(spark, sf_dir, "labels")), "cutoffs")
    q, passes = fresh_names(docs, 2)
    return passing(with_counts(docs, into=q), cut, q=q, into=passes).where(F.col(passes)).select(docs.columns)
