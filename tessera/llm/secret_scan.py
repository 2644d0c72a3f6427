"""Secret scan with multipart credential linking.

Three kinds of strong findings stand alone: assignments to a secret-like name,
cloud access identifiers, and long hex strings. Three kinds of weak candidates
say little alone: identifier-like tokens, random-looking tokens, and endpoints.
A weak candidate is reported only where complementary parts start within REACH
code points of its own start inside the same scope (a row's text): an identifier needs a
secret, a secret an identifier or endpoint, an endpoint both. A weak
candidate that overlaps a strong finding is dropped.

The interval join is a range frame over the parts of a scope in order of their starts,
so its work grows with the number of parts, not of pairs. All of it is Spark's own
functions: no Python runs on the executors.

Defined cases: a null text is empty and has no spans. Repeated rows are scanned one by
one. Positions are code points, ends exclusive. An empty table gives an empty
result. Only the id and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table

REACH = 200
#: Kind: (pattern, the group whose length counts and its least length, what a text must contain to be searched, role).
KINDS = {
    "assign": ("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", (1, 8), (":", "="), "secret"),
    "access": ("AKIA[A-Z0-9]{12,}", (0, 16), ("AKIA",), "id"),
    "hex": ("[0-9a-f]{32,}", (0, 32), (), "secret"),
    "weak_id": ("(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])", (0, 16), (), "id"),
    "weak_secret": ("(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{40,64}=?(?![A-Za-z0-9+/=])", (0, 40), (), "secret"),
    "endpoint": ("https?://[A-Za-z0-9.-]+(?::[0-9]+)?", (0, 8), ("://",), "endpoint"),
}
STRONG = ("assign", "access", "hex")


def _matches(kind: str) -> Column:
    """Array of (gap, length, ok): code points between a match and the one before, its own, and whether it counts."""
    pattern, (group, least), needs, _ = KINDS[kind]
    text, p = F.col("text"), F.lit(pattern)
    found = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    found = F.transform(F.filter(found, lambda m: m["match"].isNotNull()), lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("length"), (F.length(m["part"]) >= least).alias("ok")))
    there = text.rlike(pattern)
    for k, word in enumerate(needs):
        any_ = text.contains(word) if not k else any_ | text.contains(word)
    return F.when(any_ & there if needs else there, found)


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, found) of each row; found: an array of (kind's number, its matches), null where nothing matches."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "id", F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), _matches(kind).alias("matches")) for k, kind in enumerate(KINDS)]), lambda x: x["matches"].isNotNull()).alias("found"))
    return rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")))


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """found: parts(). (row, kind number, start, end) of the strong findings and the weak candidates that complementary parts confirm."""
    names = list(KINDS)
    matched = found.where("found is not null").select("row", F.explode("found").alias("f")).select("row", "f.kind", F.posexplode("f.matches").alias("i", "m"))
    upto = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = matched.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(upto)).where("m.ok").select("row", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end")
    scope = W.partitionBy("row").orderBy("start")
    near = scope.rangeBetween(-reach, reach)

    def role(name: str) -> Column:
        return F.col("kind").isin([k for k, kind in enumerate(names) if KINDS[kind][3] == name])

    strong = F.col("kind") < len(STRONG)
    seen = placed.select(
        "*",
        *[F.max(role(r)).over(near).alias(f"near_{r}") for r in ("id", "secret", "endpoint")],
        F.max(F.when(strong, F.col("end"))).over(scope.rangeBetween(W.unboundedPreceding, 0)).alias("covered_to"),
        F.min(F.when(strong, F.col("start"))).over(scope.rangeBetween(0, W.unboundedFollowing)).alias("next_strong"),
    )
    free = (F.coalesce("covered_to", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next_strong") >= F.col("end"), F.lit(True))
    confirmed = (role("id") & F.col("near_secret")) | (role("secret") & (F.col("near_id") | F.col("near_endpoint"))) | (role("endpoint") & F.col("near_id") & F.col("near_secret"))
    return seen.where(strong | (free & confirmed)).select("row", "kind", "start", "end")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(row, id, spans) of every row; spans: array of (start, kind number, end), in order."""
    found, _ = materialise(parts(df, id_col, text_col), "parts")
    spans = linked_spans(found, reach).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row", "id").join(spans, "row", "left").select("row", "id", F.coalesce("spans", none).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the strong findings and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    strong = F.filter("spans", lambda s: s["kind"] < len(STRONG))
    counts = [F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["kind"] == F.lit(STRONG.index(kind))).cast("long")).alias(f"n_{kind}") for kind in STRONG]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(told(strong), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
