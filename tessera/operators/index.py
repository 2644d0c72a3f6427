"""The index: features and weights, hashed vectors, incremental differences, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.functions.text import content_hash, ngram_features


def feature_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(feature, df) over all chunks."""
    return chunks.select(F.explode(F.array_distinct(ngram_features(F.col(text)))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))


def fit_digest(frequencies: DataFrame) -> str:
    """Digest of a feature table that doesn't need its rows in one place: XOR and sum of the rows' hashes."""
    h = F.xxhash64("feature", "df")
    n, x, s = frequencies.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n:x}-{x & (2**64 - 1):016x}-{int(s) & (2**64 - 1):016x}"


def embedder_digest(provider: str, model: str, dim: int, fit: str) -> str:
    """What vectors must have in common to be compared."""
    return f"{provider}:{model}:{dim}:{fit}"


def content_digest(chunks: DataFrame) -> str:
    """Digest of all chunks' ids and texts, by XOR and number; it doesn't depend on their order."""
    n, x = chunks.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("id", "text")), F.lit(0))).first()
    return f"{n:x}-{x & (2**64 - 1):016x}"


def dimension(vectors: DataFrame | None, probe) -> int:
    """The length of the vectors there are; without any, that of probe(), a vector of some text."""
    row = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).first() if vectors is not None else None
    return row.n if row else len(probe())


def by_id(chunks: DataFrame, ids: DataFrame, key: str = "id", order: str = "chunk_ord") -> DataFrame:
    """The chunks that ids (a column of that name) name; of chunks with the same id the last. Ids that no chunk has give no row."""
    wanted = chunks.join(ids.select(key).distinct(), key, "left_semi")
    return wanted.groupBy(key).agg(F.max_by(F.struct(*[c for c in chunks.columns if c != key]), order).alias("_c")).select(key, "_c.*")


def tfidf(chunks: DataFrame, key: str, frequencies: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(key, feature, weight); features that the table hasn't are dropped."""
    tf = chunks.select(key, F.explode(ngram_features(F.col(text))).alias("feature")).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.log("tf")) * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    return tf.join(frequencies, "feature").select(key, "feature", weight.alias("weight"))


def bucket_of(feature: Column, dim: int = v.EMBEDDING_DIM) -> tuple[Column, Column]:
    """Place and sign of a feature in a hashed vector."""
    h = F.xxhash64(feature)
    return F.pmod(h, F.lit(dim)).cast("int"), F.when(F.shiftrightunsigned(h, 63) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed_vectors(weights: DataFrame, key: str, dim: int = v.EMBEDDING_DIM) -> DataFrame:
    """(key, embedding): signed sums by bucket, of unit length."""
    bucket, sign = bucket_of(F.col("feature"), dim)
    summed = weights.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign * F.col("weight")).alias("x"))
    sparse = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm"))).cast("float"))
    return sparse.select(key, at.alias("embedding"))


def difference(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """(key, state): new, updated, unchanged or removed, by key and content_hash (and digest where both have it)."""
    cols = ["content_hash", *[c for c in ("digest",) if c in new.columns and c in old.columns]]
    a = new.select(key, F.struct(*cols).alias("now"))
    b = old.select(key, F.struct(*cols).alias("was"))
    state = F.when(F.col("was").isNull(), F.lit("new")).when(F.col("now").isNull(), F.lit("removed")).when(F.col("now") == F.col("was"), F.lit("unchanged")).otherwise(F.lit("updated"))
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def statistics(states: DataFrame) -> DataFrame:
    """One row: total, new, updated, unchanged, removed, re_embedded."""
    count = lambda *names: F.count_if(F.col("state").isin(*names))
    return states.agg(count("new", "updated", "unchanged").alias("total_chunks"), *[count(s).alias(s) for s in ("new", "updated", "unchanged", "removed")], count("new", "updated").alias("re_embedded"))


def reindex(chunks: DataFrame, old: DataFrame | None, embed, digest: str, key: str = "id") -> DataFrame:
    """Vectors of all chunks; embed (a function of the rows to embed, adding embedding) runs on changed ones only.

    old: (key, content_hash, digest, embedding). Vectors under another digest aren't reused.
    """
    now = chunks.withColumn("content_hash", content_hash(F.col("text")))
    if old is None:
        return embed(now).withColumn("digest", F.lit(digest))
    on = [key, "content_hash"]
    valid = old.where(F.col("digest") == digest)
    reused = now.join(valid.select(*on, "embedding"), on)
    fresh = embed(now.join(valid.select(*on), on, "left_anti"))
    return reused.unionByName(fresh.select(reused.columns)).withColumn("digest", F.lit(digest))


def save_snapshot(df: DataFrame, folder: str) -> str:
    """Writes a version beside the others, then points to it: readers see the old one or the new, never a part."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/_pointer_{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    fs = path("pointer").getFileSystem(conf)
    fs.delete(path("pointer"), True)
    fs.rename(path(f"_pointer_{version}"), path("pointer"))
    return version


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The version that the pointer names; None (a cold start) where there is none to read."""
    from pyspark.errors import PySparkException

    try:
        version = spark.read.schema("version string").json(f"{folder}/pointer").first()
        return spark.read.parquet(f"{folder}/{version.version}") if version else None
    except PySparkException:
        return None
