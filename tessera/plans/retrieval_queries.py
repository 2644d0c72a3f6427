"""Queries of scoring, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.operators import bm25, compose, fusion, index
from tessera.plans import sql
from tessera.plans.registry import query, table
from tessera.sources.steps import written


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


_TOKENS = f"tok AS (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents), len0 AS (SELECT doc_id, greatest(len({sql.tokens('text')}), 1) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len0), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_SCORES = f"qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql.tokens('text')}) AS term FROM benchmark) GROUP BY ALL), sc AS (SELECT query_id, doc_id, round(sum(qtf * {sql.idf('n', 'df')} * {sql.weight('tf', 'dl', 'avgdl')}), 9) AS bm25 FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN len0 USING (doc_id), st GROUP BY query_id, doc_id)"


@query(f"WITH {_TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def doc_lengths_avgdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_size(table(spark, sf_dir, "documents"), "doc_id").select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_TOKENS} SELECT term, df, round({sql.idf('n', 'df')}, 6) AS idf FROM dfs, st")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_statistics(table(spark, sf_dir, "documents"), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TOKENS}, {_SCORES} SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM sc WHERE bm25 > 0) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    (found,) = bm25.best(table(spark, sf_dir, "documents"), asked(spark, sf_dir), "doc_id", 10)
    return found.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {_TOKENS}, {_SCORES} SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank::INT AS rank FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE bm25 > 0 AND lang = 'fr') WHERE rank <= 10")
def bm25_filtered_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the global statistics and before the ranks."""
    (found,) = bm25.best(table(spark, sf_dir, "documents"), asked(spark, sf_dir).withColumn("f_lang", F.lit("fr")), "doc_id", 10, match=[("lang", "f_lang")])
    return found.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


_FIRST = f"r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM sc WHERE bm25 > 0 QUALIFY rank <= {v.POOL})"
_SECOND = f"r2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, count(*) AS shared FROM qt JOIN tf USING (term) GROUP BY ALL) QUALIFY rank <= {v.POOL})"
_FUSED = f"fu AS (SELECT query_id, doc_id, r1.rank AS rank_0, r2.rank AS rank_1, coalesce(1::DOUBLE / ({v.RRF_K} + r1.rank), 0) + coalesce(1::DOUBLE / ({v.RRF_K} + r2.rank), 0) AS rrf FROM r1 FULL JOIN r2 USING (query_id, doc_id)), pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, doc_id) AS rank FROM fu QUALIFY rank <= {v.POOL})"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with the number of shared terms."""
    both = bm25.best(table(spark, sf_dir, "documents"), asked(spark, sf_dir), "doc_id", v.POOL, kinds=("bm25", "shared"))
    return fusion.reciprocal_ranks(both, "doc_id")


@query(f"WITH {_TOKENS}, {_SCORES}, {_FIRST}, {_SECOND}, {_FUSED} SELECT query_id, doc_id, round(rrf, 9) AS rrf, rank::INT AS rank FROM pool")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rank")


_POOLED = (
    f"pt AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT query_id, doc_id, unnest({sql.tokens('text')}) AS term FROM pool JOIN documents USING (doc_id)) GROUP BY ALL), "
    "pl AS (SELECT query_id, doc_id, dl, count(*) OVER (PARTITION BY query_id) AS n, avg(dl) OVER (PARTITION BY query_id) AS avgdl FROM pool JOIN len0 USING (doc_id)), pd AS (SELECT query_id, term, count(*) AS df FROM pt GROUP BY ALL), "
    f"rr AS (SELECT query_id, doc_id, sum(qtf * {sql.idf('n', 'df')} * {sql.weight('tf', 'dl', 'avgdl')}) AS rerank FROM pt JOIN qt USING (query_id, term) JOIN pd USING (query_id, term) JOIN pl USING (query_id, doc_id) GROUP BY ALL), "
    "re AS (SELECT pool.*, coalesce(rerank, 0) AS rerank FROM pool LEFT JOIN rr USING (query_id, doc_id)), "
    "bl AS (SELECT *, rrf * (1 + (rerank - min(rerank) OVER q) / CASE WHEN max(rerank) OVER q = min(rerank) OVER q THEN 1 ELSE max(rerank) OVER q - min(rerank) OVER q END) AS final FROM re WINDOW q AS (PARTITION BY query_id))"
)


@query(f"WITH {_TOKENS}, {_SCORES}, {_FIRST}, {_SECOND}, {_FUSED}, {_POOLED} SELECT query_id, doc_id, round(final, 9) AS final, (row_number() OVER (PARTITION BY query_id ORDER BY round(final, 12) DESC, rank, doc_id))::INT AS final_rank FROM bl")
def pool_rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = written(_fused(spark, sf_dir), "fused").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(asked(spark, sf_dir), "query_id")
    return fusion.blend(bm25.pool_scores(pool, "query_id", "doc_id"), "doc_id").select("query_id", "doc_id", F.round("final", 9).alias("final"), "final_rank")


_COSINE = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as questions those whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, vec_id, round(s, 6) AS dense, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.format(a='q.embedding', b='e.embedding')} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND s > {v.DENSE_FLOOR}) WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, questions = _vectors(spark, sf_dir)
    return fusion.dense_top(vectors, questions, "vec_id", "query_id", 10).select("query_id", "vec_id", F.round("dense", 6).alias("dense"), "rank")


@query(f"SELECT query_id, vec_id AS cached, round(s, 6) AS cosine FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.format(a='q.embedding', b='e.embedding')} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.label = e.label AND e.vec_id <> q.vec_id AND s >= 0.2) WHERE rank = 1")
def semantic_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the most similar other vector with the same label, at cosine 0.2 or more."""
    rows = table(spark, sf_dir, "embeddings")
    questions = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("own"))
    near = fusion.dense_top(rows, questions, "vec_id", "query_id", 2, floor=0.2 - 1e-12, match=[("label", "own")]).where("vec_id <> query_id")
    return bm25.top(near.drop("rank").withColumn("r", F.round("dense", 9)), "r", "vec_id", 1).select("query_id", F.col("vec_id").alias("cached"), F.round("dense", 6).alias("cosine"))


@query(f"SELECT query_id, vec_id AS entry, round(s, 6) AS cosine FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.format(a='q.embedding', b='e.embedding')} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0 AND q.label = e.label AND s >= 0.2) WHERE rank = 1")
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the questions asked against all others as entries of a cache; labels stand for scopes."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("own"))
    found = fusion.cached(rows.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "entry"), asked, "entry", "query_id", [("label", "own")], 0.2)
    return found.select("query_id", "entry", F.round("cosine", 6).alias("cosine"))


@query("SELECT conv_id AS id, max(turn) AS chunk_ord, arg_max(text, turn) AS text FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id")
def chunk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for ids that occur more than once, turns for their order: the last one is found."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("chunk_ord"), "text")
    return index.by_id(chunks, chunks.where("id % 3 = 0"))


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, questions = _vectors(spark, sf_dir)
    pool = fusion.dense_top(vectors, questions, "vec_id", "query_id", v.POOL).join(vectors, "vec_id")
    return fusion.diversify(pool, "vec_id", "query_id", 10)


_SAFE = f"safe AS (SELECT doc_id, lang, {sql.content_tokens('text')} AS w FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) USING (doc_id)), q AS (SELECT item_id, {sql.content_tokens('text')} AS q FROM benchmark)"


@query(f"WITH {_SAFE} SELECT item_id AS query_id, doc_id AS chunk_ord, o::BIGINT AS overlap FROM (SELECT item_id, doc_id, len(list_intersect(q, w)) AS o, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, doc_id) AS n FROM q, safe WHERE lang = 'en' OR NOT EXISTS (SELECT 1 FROM safe WHERE lang = 'en')) WHERE n = 1")
def nearest_safety_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic stand for safety chunks, languages for units."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    chunks = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(F.col("doc_id").alias("chunk_ord"), "text", F.lit(True).alias("safety"), F.col("lang").alias("unit_model"))
    return compose.nearest_safety(asked(spark, sf_dir).withColumn("unit_model", F.lit("en")), chunks)
