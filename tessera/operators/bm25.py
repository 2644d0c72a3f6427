"""BM25 as joins: statistics over all chunks, scores for a table of questions.

Only terms that some question has leave the tokenisation, so postings shuffle in
proportion to what is asked. Statistics are global; filters apply to scores, after.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocabulary as v
from tessera.functions.text import tokenize
from tessera.operators.topk import Bars, Match, allowed, collected, match_columns, objects
from tessera.sources.steps import written

#: A question table with more terms than this is joined by shuffle, not broadcast.
MOST_TERMS = 500_000
#: Chunks, and terms of questions, in one product of matrices.
ROWS, ASKED = 1024, 4096


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; they are counted first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lengths(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, dl): tokens of each chunk, 1 at least."""
    return chunks.select(key, F.greatest(F.size(tokenize(F.col(text))), F.lit(1)).alias("dl"))


def corpus_size(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row (n, avgdl)."""
    return lengths(chunks, key, text).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_statistics(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf) of every term of the corpus."""
    terms = chunks.select(key, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))
    found = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.count()
    return found.select("term", "df", idf(F.lit(n), F.col("df")).alias("idf"))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = v.K1, b: float = v.B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def scores(chunks: DataFrame, questions: DataFrame, key: str, query_key: str = "query_id", text: str = "text", question: str = "question") -> DataFrame:
    """(query_key, key, bm25) of chunks that share a term with the question; a term asked twice counts twice."""
    asked = questions.select(query_key, F.explode(tokenize(F.col(question))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    vocabulary = bounded_broadcast(asked.select("term").distinct(), MOST_TERMS)
    tokens = chunks.select(key, tokenize(F.col(text)).alias("tokens"))
    postings = tokens.select(key, F.greatest(F.size("tokens"), F.lit(1)).alias("dl"), F.explode("tokens").alias("term")).join(vocabulary, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = corpus_size(chunks, key, text).first()
    weighed = postings.join(found, "term").select(key, "term", (idf(F.lit(size.n), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.lit(size.avgdl))).alias("w"))
    return weighed.join(asked, "term").groupBy(query_key, key).agg(F.sum(F.col("qtf") * F.col("w")).alias("bm25"))


def postings(chunks: DataFrame, key: str, terms: list[str], keep: Sequence[Column] = (), text: str = "text") -> DataFrame:
    """(key, kept columns, dl, terms, tfs) of every chunk, written: places in the list of terms, and how often they occur. Texts are tokenised once."""
    sent = chunks.sparkSession.sparkContext.broadcast(terms)
    rows = chunks.select(F.col(key).cast("long").alias(key), *keep, tokenize(F.col(text)).alias("tokens"))
    n_kept = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:n_kept], T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, type=pa.string())
        for batch in batches:
            tokens = batch.column(n_kept)
            size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(len(size)), size)[place >= 0]
            pairs, tf = np.unique(doc * len(known) + place[place >= 0], return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // max(len(known), 1), minlength=len(size)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), tf)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(np.maximum(size, 1).astype(np.int32)), *lists], schema.names)

    return written(rows.mapInArrow(run, schema), "postings")


def best(chunks: DataFrame, questions: DataFrame, key: str, k: int, query_key: str = "query_id", text: str = "text", question: str = "question", match: Match = (), kinds: Sequence[str] = ("bm25",), digits: int = 9) -> list[DataFrame]:
    """For each kind (bm25, or shared: how many terms are) the k best chunks of each question: (query_key, key, kind, rank); ties by key.

    Up to MOST_TERMS terms of all questions are broadcast; a task scores its chunks against all questions as products of
    matrices, and only what may be among its k best leaves it. With more of them, scores are joined. match filters before the ranks,
    not the statistics. Scores are rounded to digits before they are ranked.
    """
    asked = questions.select(query_key, F.explode(tokenize(F.col(question))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = collected(asked.select(F.col(query_key).cast("long").alias("q"), "term", "qtf"), MOST_TERMS)
    if rows is None:
        return [_joined_best(chunks, questions, asked, key, k, query_key, text, question, match, kind, digits) for kind in kinds]
    terms = sorted({r.term for r in rows})
    at = {t: i for i, t in enumerate(terms)}
    ids = sorted({r.q for r in rows})
    spot = {q: i for i, q in enumerate(ids)}
    demands = {r[0]: r[1:] for r in questions.select(F.col(query_key).cast("long"), *match_columns(match, True)).where(F.col(query_key).isin(ids)).collect()} if match else {}
    listed = postings(chunks, key, terms, match_columns(match, False), text)
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")).first()
    found = np.zeros(len(terms))
    for r in listed.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        found[r.t] = r.df
    weight = np.log((size.n - found + 0.5) / (found + 0.5) + 1)
    triples = np.array([(spot[r.q], at[r.term], r.qtf) for r in rows], dtype=np.int64).reshape(-1, 3)
    sent = chunks.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), triples[np.argsort(triples[:, 0], kind="stable")], weight, [objects([demands[q][m] for q in ids]) for m in range(len(match))]))
    avgdl = float(size.avgdl)

    def scored(kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, triples, weight, wanted = sent.value
            bars, column = Bars(len(ids), k, 0.0), np.full(len(weight), -1)
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    keys, dl = part.column(0).to_numpy(), part.column(1 + len(match)).to_numpy()
                    listed, tf = part.column(2 + len(match)), part.column(3 + len(match)).flatten().to_numpy()
                    doc = np.repeat(np.arange(len(keys)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
                    term = listed.flatten().to_numpy()
                    worth = weight[term] * term_weight(tf, dl[doc], avgdl) if kind == "bm25" else np.ones(len(term))
                    fits = allowed(wanted, [objects(part.column(1 + m).to_pylist()) for m in range(len(match))])
                    first = 0
                    while first < len(triples):
                        # Whole questions of about ASKED terms together.
                        last = int(np.searchsorted(triples[:, 0], triples[min(first + ASKED, len(triples)) - 1, 0], side="right"))
                        own = triples[first:last]
                        q = slice(int(own[0, 0]), int(own[-1, 0]) + 1)
                        used = np.unique(own[:, 1])
                        column[used] = np.arange(len(used))
                        b = np.zeros((q.stop - q.start, len(used)))
                        b[own[:, 0] - q.start, column[own[:, 1]]] = own[:, 2] if kind == "bm25" else 1.0
                        a = np.zeros((len(used), len(keys)))
                        of = column[term]
                        a[of[of >= 0], doc[of >= 0]] = worth[of >= 0]
                        column[used] = -1
                        scores = np.round(b @ a, digits)
                        i, j = np.nonzero(bars.keep(q, scores, None if fits is None else fits[q]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q][i]), pa.array(keys[j]), pa.array(scores[i, j])], [query_key, key, kind])
                        first = last

        # Written: what is built on it reads few rows, and the products aren't done twice.
        return top(written(listed.mapInArrow(run, f"{query_key} long, {key} long, {kind} double"), kind), kind, key, k, query_key)

    return [scored(kind) for kind in kinds]


def _joined_best(chunks, questions, asked, key, k, query_key, text, question, match, kind, digits) -> DataFrame:
    if kind == "bm25":
        found = scores(chunks, questions, key, query_key, text, question)
    else:
        terms = chunks.select(key, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))
        found = terms.join(asked, "term").groupBy(query_key, key).agg(F.count(F.lit(1)).cast("double").alias(kind))
    if match:
        found = found.join(chunks.select(key, *match_columns(match, False)), key).join(questions.select(query_key, *[c.alias(f"_q{i}") for i, c in enumerate(match_columns(match, True))]), query_key)
        for i in range(len(match)):
            found = found.where(F.col(f"_q{i}").isNull() | (F.col(f"_q{i}") == F.col(f"_m{i}")))
    return top(found.select(query_key, key, F.round(kind, digits).alias(kind)), kind, key, k, query_key)


def top(scored: DataFrame, score: str, key: str, k: int, query_key: str = "query_id", floor: float = 0.0) -> DataFrame:
    """The k best of each question above the floor, with rank; ties by key."""
    order = W.partitionBy(query_key).orderBy(F.desc(score), F.asc(key))
    return scored.where(F.col(score) > floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool_scores(pool: DataFrame, query_key: str, key: str, question: str = "question", text: str = "text") -> DataFrame:
    """BM25 with the statistics of each question's own pool. pool: (query_key, key, question, text). Adds rerank; 0 without shared terms."""
    tokens = pool.select(query_key, key, tokenize(F.col(question)).alias("q"), tokenize(F.col(text)).alias("tokens"))
    in_pool = W.partitionBy(query_key)
    sized = tokens.withColumn("dl", F.greatest(F.size("tokens"), F.lit(1))).withColumn("n", F.count(F.lit(1)).over(in_pool)).withColumn("avgdl", F.avg("dl").over(in_pool))
    asked = sized.select(query_key, key, "dl", "n", "avgdl", "q", F.explode("tokens").alias("term")).where(F.array_contains("q", F.col("term")))
    counted = asked.groupBy(query_key, key, "dl", "n", "avgdl", "term").agg(F.count(F.lit(1)).alias("tf"), F.first(F.size(F.filter("q", lambda t: t == F.col("term")))).alias("qtf"))
    counted = counted.withColumn("df", F.count(F.lit(1)).over(W.partitionBy(query_key, "term")))
    summed = counted.groupBy(query_key, key).agg(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("rerank"))
    return pool.join(summed, [query_key, key], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
