"""Dense scores, rank fusion, rerank blend and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.operators.topk import Bars, Match, allowed, match_columns, objects

#: Questions whose vectors are sent to the executors at once.
QUESTION_BLOCK = 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1.0, norm)


def dense_top(vectors: DataFrame, questions: DataFrame, key: str, query_key: str, k: int, vector: str = "embedding", floor: float = v.DENSE_FLOOR, match: Match = ()) -> DataFrame:
    """(query_key, key, dense, rank): the k most similar vectors by cosine above the floor; a zero vector is similar to none.

    Question vectors go out in blocks of QUESTION_BLOCK. Of a question a task gives only what may be among its k best, with all
    that tie with the k-th by rounded cosine, not all pairs. match filters before the ranks.
    """
    spark = vectors.sparkSession
    schema = f"{query_key} long, {key} long, dense double"
    parts: list[DataFrame] = []

    def scored(block: list) -> DataFrame:
        wanted = [objects([r[2 + m] for r in block]) for m in range(len(match))]
        ids = spark.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), _unit(np.array([r[1] for r in block], dtype=np.float64)), wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked, wanted = ids.value
            bars = Bars(len(names), k, floor)
            for batch in batches:
                own = batch.column(0).to_numpy()
                if not len(own):
                    continue
                x = _unit(np.array(batch.column(1).to_pylist(), dtype=np.float64))
                fits = allowed(wanted, [objects(batch.column(2 + m).to_pylist()) for m in range(len(match))])
                for at in range(0, len(names), 256):
                    block = slice(at, min(at + 256, len(names)))
                    sim = asked[block] @ x.T
                    q, i = np.nonzero(bars.keep(block, np.round(sim, 9), None if fits is None else fits[block]) & (sim > floor))
                    yield pa.RecordBatch.from_arrays([pa.array(names[block][q]), pa.array(own[i]), pa.array(sim[q, i])], [query_key, key, "dense"])

        return vectors.select(F.col(key).cast("long").alias(key), vector, *match_columns(match, False)).mapInArrow(run, schema)

    block: list = []
    for row in questions.select(F.col(query_key).cast("long"), vector, *match_columns(match, True)).toLocalIterator():
        block.append(row)
        if len(block) == QUESTION_BLOCK:
            parts.append(scored(block))
            block = []
    if block or not parts:
        parts.append(scored(block) if block else spark.createDataFrame([], schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = W.partitionBy(query_key).orderBy(F.desc(F.round("dense", 9)), F.asc(key))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cached(entries: DataFrame, questions: DataFrame, key: str, query_key: str, match: Match, threshold: float = v.SEMANTIC_CACHE) -> DataFrame:
    """(query_key, key, cosine): for each question the most similar entry that match allows, at the threshold or above; of equal ones the first."""
    near = dense_top(entries, questions, key, query_key, 1, floor=threshold - 1e-12, match=match)
    return near.select(query_key, key, F.col("dense").alias("cosine"))


def reciprocal_ranks(branches: list[DataFrame], key: str, query_key: str = "query_id", k: int = v.RRF_K, pool: int = v.POOL) -> DataFrame:
    """branches: (query_key, key, rank), best first. (query_key, key, rrf, rank_0, rank_1, ..., rank): the pool best.

    Ties go to the better rank in the first branch that tells, then by key.
    """
    parts = [b.select(query_key, key, *[(F.col("rank") if i == j else F.lit(None).cast("int")).alias(f"rank_{j}") for j in range(len(branches))]) for i, b in enumerate(branches)]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    ranks = [f"rank_{j}" for j in range(len(branches))]
    fused = both.groupBy(query_key, key).agg(*[F.min(r).alias(r) for r in ranks])
    fused = fused.withColumn("rrf", sum((F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0)) for r in ranks), F.lit(0.0)))
    order = W.partitionBy(query_key).orderBy(F.desc("rrf"), *[F.asc_nulls_last(r) for r in ranks], F.asc(key))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def blend(pool: DataFrame, key: str, query_key: str = "query_id", weight: float = v.RERANK_BLEND, top_k: int | None = None) -> DataFrame:
    """pool: rrf, rank, rerank. Adds final and final_rank; with top_k only the best stay, without the whole pool."""
    own = W.partitionBy(query_key)
    span = F.max("rerank").over(own) - F.min("rerank").over(own)
    norm = (F.col("rerank") - F.min("rerank").over(own)) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    out = pool.withColumn("final", F.col("rrf") * (1 + weight * norm))
    out = out.withColumn("final_rank", F.row_number().over(own.orderBy(F.desc(F.round("final", 12)), F.asc("rank"), F.asc(key))))
    return out if top_k is None else out.where(F.col("final_rank") <= top_k)


def diversify(pool: DataFrame, key: str, query_key: str, k: int, vector: str = "embedding", rank: str = "rank", lam: float = v.MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance over each question's pool (bounded by its size): (query_key, key, mmr_rank).

    The first item is taken; then each time the one with most similarity to the first, less its likeness to what was taken.
    """

    def choose(rows):
        rows = rows.sort_values([rank, key])
        x = _unit(np.array(rows[vector].tolist(), dtype=np.float64))
        sim = x @ x.T
        taken, nearest = [0], sim[0].copy()
        open_ = np.ones(len(rows), dtype=bool)
        open_[0] = False
        while open_.any() and len(taken) < k:
            worth = np.where(open_, lam * sim[0] - (1 - lam) * nearest, -np.inf)
            best = int(np.argmax(worth))
            taken.append(best)
            open_[best] = False
            nearest = np.maximum(nearest, sim[best])
        out = rows.iloc[taken][[query_key, key]].copy()
        out["mmr_rank"] = np.arange(1, len(taken) + 1, dtype=np.int32)
        return out

    return pool.groupBy(query_key).applyInPandas(choose, f"{query_key} long, {key} long, mmr_rank int")
