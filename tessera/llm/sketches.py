"""Bottom-k sketches of word shingles: document fingerprints that merge.

A text's sketch is the K smallest distinct hashes of its shingles of five words
(fewer words: the whole sequence is one shingle; none: no shingle).
Sketches of parts merge to the sketch of the whole, and two sketches estimate
resemblance, containment and each text's number of distinct shingles (Broder
1997; Cohen and Kaplan 2007). All of it is Spark's own functions: no Python
runs on the executors.

Defined cases: a null text is empty. Two texts without words have resemblance 1,
one without and one with words 0. Repeated rows are rows of their own. The next
document of a row is the one with the next smaller id (null ids come last; among equal ids the
order is by text), after the last the first; a table of one row is its own next. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, small, table

K, SHINGLE, BITS = 128, 5, 48
#: Rows between two documents of which the place in the whole order is settled apart.
RUN = 512
_BLANKS = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once and not for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sorted array of the k smallest distinct shingle hashes, each of BITS bits."""
    spoken = F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")

    def hashes(words: Column) -> Column:
        first = F.slice(words, 1, F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
        return F.transform(first, lambda h, i: F.shiftrightunsigned(F.xxhash64(h, *[F.get(words, i + j) for j in range(1, shingle)]), 64 - BITS))

    return F.slice(F.sort_array(F.array_distinct(_let(F.transform(spoken, lambda w: F.xxhash64(w)), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.greatest(F.element_at(a, k), F.lit(1)).cast("double")))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 1 for an a without shingles."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def as_text(a: Column) -> Column:
    """The sketch's hashes, as many hex digits each."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def edited_and_next(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs: (doc_id, text). op6's columns, with estimated distinct shingles and containment beside them.

    Ids are cut into ranges of about run rows, and a window looks for the next
    row inside each range, so texts are shuffled once. The row that begins a
    range, one in about run, is read apart; it follows the last row of the range above.
    """
    spark = docs.sparkSession
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    width = max(1, (high - low + 1) * run // n) if low is not None else 1
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.withColumn("part", F.coalesce(F.expr(f"(doc_id - {low or 0}) div {width}"), F.lit(-1).cast("long")))
    heads, _ = materialise(rows.groupBy("part").agg(F.max(key).alias("top")), "heads")
    first = docs.join(small(heads, 1_000_000), key == heads["top"], "inner").groupBy("part").agg(F.min("text").alias("head_text"))
    first, _ = materialise(first.withColumn("head_sketch", sketch(F.col("head_text"))), "heads")
    # One narrow row for each range: the range below it, and below the lowest the highest.
    below = heads.select("part", F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.partitionBy())).alias("next_part"))
    follow = below.join(first.withColumnRenamed("part", "next_part"), "next_part").drop("next_part")
    inner = W.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    dealt = rows.withColumn("sketch", sketch(F.col("text"))).repartition("part")
    seen = dealt.select("*", F.lead("text").over(inner).alias("lead_text"), F.lead("sketch").over(inner).alias("lead_sketch")).join(follow, "part")
    paired = seen.select("doc_id", "text", "sketch", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_sketch", "head_sketch").alias("next_sketch"))
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = paired.withColumn("n_chars", n_chars.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    both = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's."""
    return edited_and_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
