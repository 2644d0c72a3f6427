"""Answers: guardrail, extractive text, prompt blocks, citations.

ranked tables have one row for each question and chunk: query_id, question, rank, chunk_ord, text, safety, and further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.functions.text import answer_words, content_tokens, safety_topics, sentences


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def quotes(pairs: DataFrame, keys: list[str], question: str = "question", text: str = "text", most: int = 4) -> DataFrame:
    """(keys, pos, sentence, overlap, n): the sentences that share most words with the question, in order of overlap and place."""
    each = pairs.select(*keys, content_tokens(F.col(question)).alias("q"), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    scored = each.withColumn("overlap", overlap(F.col("q"), content_tokens(F.col("sentence")))).where("overlap > 0")
    order = W.partitionBy(*keys).orderBy(F.desc("overlap"), "pos")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*keys, "pos", F.trim("sentence").alias("sentence"), "overlap", "n")


def guardrail(questions: DataFrame, ranked: DataFrame, direct: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """(query_id, escalate, topics) of each question: hazardous work without a safety section among the first GUARDRAIL_WINDOW."""
    asked = questions.select("query_id", "question", safety_topics(F.col("question")).alias("asked_topics"), F.col("question").rlike(v.PROCEDURAL_ASK).alias("procedural"))
    quoted = quotes(ranked.where("rank = 1"), ["query_id"]).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(safety_topics(F.col("sentence"))))).alias("quoted_topics"))
    support = ranked.where(F.col("rank") <= v.GUARDRAIL_WINDOW).groupBy("query_id").agg(F.bool_or("safety").alias("support"))
    out = asked.join(quoted, "query_id", "left").join(support, "query_id", "left")
    none = F.array().cast("array<string>")
    topics = F.array_sort(F.array_union("asked_topics", F.when(F.col("procedural"), F.coalesce("quoted_topics", none)).otherwise(none)))
    exempt = F.lit(not enabled)
    if direct is not None:
        out = out.join(direct.select("query_id").distinct().withColumn("hit", F.lit(True)), "query_id", "left")
        exempt = exempt | F.coalesce("hit", F.lit(False))
    out = out.withColumn("topics", F.when(exempt, none).otherwise(topics))
    return out.select("query_id", ((F.size("topics") > 0) & ~F.coalesce("support", F.lit(False))).alias("escalate"), "topics")


def nearest_safety(questions: DataFrame, chunks: DataFrame, unit: str = "unit_model") -> DataFrame:
    """(query_id, chunk_ord, overlap): the safety chunk of the question's unit with most shared words, of all units where it has none; ties to the first.

    The index side is reduced to the chunks that are about safety; each question meets them through shared words, and those without any through the first.
    """
    safe = chunks.where("safety").select("chunk_ord", F.col(unit).alias("chunk_unit"), content_tokens(F.col("text")).alias("words"))
    asked = questions.select("query_id", F.col(unit).alias("asked_unit"), content_tokens(F.col("question")).alias("q"))
    own_units = safe.select("chunk_unit").distinct().withColumn("own", F.lit(True))
    asked = asked.join(own_units, F.col("asked_unit") == F.col("chunk_unit"), "left").select("query_id", "q", F.when(F.coalesce("own", F.lit(False)), F.col("asked_unit")).alias("scope"))
    terms = safe.select("chunk_ord", "chunk_unit", F.explode("words").alias("word"))
    shared = asked.select("query_id", "scope", F.explode("q").alias("word")).join(terms, "word").where("scope is null or scope = chunk_unit").groupBy("query_id", "chunk_ord").agg(F.count(F.lit(1)).alias("overlap"))
    first_of = safe.groupBy("chunk_unit").agg(F.min("chunk_ord").alias("first"))
    first_all = safe.agg(F.min("chunk_ord").alias("first_all"))
    start = asked.join(first_of, F.col("scope") == F.col("chunk_unit"), "left").crossJoin(F.broadcast(first_all)).select("query_id", F.coalesce("first", "first_all").alias("chunk_ord"), F.lit(0).cast("long").alias("overlap")).where("chunk_ord is not null")
    order = W.partitionBy("query_id").orderBy(F.desc("overlap"), "chunk_ord")
    return shared.union(start).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def prompt(ranked: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(query_id, blocks): exact rows first, then chunks, PROMPT_BLOCKS in all, numbered on from the exact rows."""
    hits = (direct.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("code_pos", F.concat(F.lit("[EXACT MATCH "), "code", F.coalesce(F.concat(F.lit(" ("), "unit_model", F.lit(")")), F.lit("")), F.lit("] "), "rendered_row").alias("b")))).alias("hits"))) if direct is not None else None
    near = ranked.where(F.col("rank") <= v.PROMPT_BLOCKS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.array_join("breadcrumb", " > "), F.lit("\n"), F.substring("text", 1, v.PROMPT_CHARS)).alias("b")))).alias("near"))
    out = near.join(hits, "query_id", "full_outer") if hits is not None else near.withColumn("hits", F.array().cast("array<struct<code_pos:int,b:string>>"))
    exact = F.coalesce(F.transform("hits", lambda h: h["b"]), F.array().cast("array<string>"))
    chunks = F.transform(F.coalesce("near", F.array().cast("array<struct<rank:int,b:string>>")), lambda c, i: F.concat(F.lit("[C"), i + 1 + F.size(exact), F.lit("] "), c["b"]))
    return out.select("query_id", F.slice(F.concat(exact, chunks), 1, v.PROMPT_BLOCKS).alias("blocks"))


def extractive_answer(ranked: DataFrame) -> DataFrame:
    """(query_id, answer): the best two sentences of the first chunk that shares a word with the question; else the chunk with the best score by its length and rank."""
    near = ranked.where(F.col("rank") <= v.PROMPT_BLOCKS).select("query_id", "rank", answer_words(F.col("question")).alias("q"), answer_words(F.col("text")).alias("w"), F.translate("text", "\n", " ").alias("body"))
    shares = F.size("q")
    near = near.where(F.size("w") > 0).withColumn("shared", overlap(F.col("q"), F.col("w")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1
    near = near.withColumn("score", F.col("shared") / F.greatest(shares, F.lit(1)) / F.sqrt(F.size("w")) - 0.02 * place)
    order = W.partitionBy("query_id").orderBy(F.desc(F.col("shared") > 0), F.when(F.col("shared") > 0, -F.col("rank")).otherwise(F.col("score")).desc(), "rank")
    best = near.withColumn("n", F.row_number().over(order)).where("n = 1")
    said = best.select("query_id", "q", F.posexplode(sentences(F.col("body"), newlines=False)).alias("pos", "s")).withColumn("s", F.trim("s"))
    said = said.withColumn("o", overlap(F.col("q"), answer_words(F.col("s"))))
    kept = said.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("o"), "pos"))).where("(n <= 2 and o > 0) or n = 1")
    lines = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: F.concat(F.lit("- "), x["s"])), "\n").alias("lines"))
    asked = ranked.select("query_id").distinct()
    return asked.join(lines, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit(v.ANSWER_HEADER + "\n"), "lines"), F.lit(v.NOT_COVERED)).alias("answer"))


def citations(answers: DataFrame, ranked: DataFrame, most: int = v.CITATIONS, coverage: float = v.CITATION_COVERAGE) -> DataFrame:
    """(query_id, chunk_ord, place): chunks that the answer names as [Cn], else those that have most of its words, else the best, else the first."""
    near = ranked.where(F.col("rank") <= v.PROMPT_BLOCKS).select("query_id", "chunk_ord", "rank", "text")
    pairs = answers.select("query_id", "answer", content_tokens(F.col("answer")).alias("a")).join(near, "query_id")
    marks = F.transform(F.regexp_extract_all("answer", F.lit("\\[C(\\d+)\\]"), F.lit(1)), lambda x: x.try_cast("int"))
    scored = pairs.select("query_id", "chunk_ord", "rank", F.array_position(marks, F.col("rank")).alias("mark"), (overlap(F.col("a"), content_tokens(F.col("text"))) / F.greatest(F.size("a"), F.lit(1))).alias("share"))
    own = W.partitionBy("query_id")
    scored = scored.withColumn("marked", F.max("mark").over(own) > 0).withColumn("enough", F.max("share").over(own) >= coverage)
    place = F.row_number().over(own.orderBy(F.desc(F.col("mark") > 0), F.when(F.col("marked"), F.col("mark")), F.desc("share"), "rank"))
    scored = scored.withColumn("place", place)
    keep = F.when(F.col("marked"), F.col("mark") > 0).when(F.col("enough"), F.col("share") >= coverage).otherwise(F.col("place") == 1)
    return scored.where(keep & (F.col("place") <= most)).select("query_id", "chunk_ord", "place", F.round("share", 9).alias("share"))


def with_exact_rows(answers: DataFrame, direct: DataFrame) -> DataFrame:
    """Answers with the exact rows of the question's codes put before."""
    rows = direct.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code_pos", "rendered_row"))), lambda x: F.concat(F.lit("- "), x["rendered_row"])), "\n").alias("rows"))
    return answers.join(rows, "query_id", "left").withColumn("answer", F.coalesce(F.concat(F.lit(v.EXACT_HEADER + "\n"), "rows", F.lit("\n\n"), "answer"), F.col("answer"))).drop("rows")


def events(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """Answers as they are streamed: (key, seq, event, data): meta, then a token a word with the blanks after it, then done. A null answer has no tokens."""
    tokens = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit("\\S+\\s*"), F.lit(0))
    made = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    all_ = F.concat(F.array(made("meta", F.lit(""))), F.transform(tokens, lambda t: made("token", t)), F.array(made("done", F.lit(""))))
    return answers.select(key, F.posexplode(all_).alias("seq", "e")).select(key, "seq", "e.event", "e.data")
