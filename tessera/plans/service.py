"""The whole engine on tables: documents to an index, questions to answers, golden sets to a report."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.functions import vocabulary as v
from tessera.functions.text import escalation_message
from tessera.operators import bm25, compose, evaluate, fusion, index, manuals, understand
from tessera.sources.steps import written


RERANKERS = ("bm25", "cross-encoder", "none")


@dataclass
class Settings:
    """mode: hybrid, bm25 or dense. truncate: whether top_k cuts the reranked pool. units: (pattern, implying words) by model.

    reranker: one of RERANKERS; cross_encoder and llm name models registered with functions.providers. Without an llm, answers are extracted.
    """

    mode: str = "hybrid"
    top_k: int = v.TOP_K
    pool: int = v.POOL
    reranker: str = "bm25"
    cross_encoder: str | None = None
    llm: str | None = None
    truncate: bool = True
    diversity: float | None = None
    guardrail: bool = True
    fast_path_only: bool = False
    units: dict[str, tuple[str, list[str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("hybrid", "bm25", "dense"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.reranker not in RERANKERS:
            raise ValueError(f"unknown reranker {self.reranker!r}; known: {RERANKERS}")
        if self.reranker == "cross-encoder":
            providers.provider("cross-encoder", self.cross_encoder)
        if self.llm is not None:
            providers.provider("llm", self.llm)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TESSERA_", **more) -> Settings:
        """The settings that variables like TESSERA_TOP_K give (units excepted), and more, which come first."""
        env = os.environ if env is None else env
        parse = {"int": int, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on"), "float | None": float}
        named = {f.name: parse.get(f.type, str)(env[prefix + f.name.upper()]) for f in fields(cls) if f.name != "units" and env.get(prefix + f.name.upper())}
        return cls(**{**named, **more})


@dataclass
class Index:
    chunks: DataFrame
    vectors: DataFrame
    frequencies: DataFrame
    n: int
    version: str = ""


#: What an answer has, besides its question.
ANSWER = ["answer", "citations", "code_refs", "escalation", "escalation_topics", "diagram_refs"]


def build(docs: DataFrame, settings: Settings) -> Index:
    """docs: (source_doc, doc_ord, text), and doc_type ("manual" where it is missing or null). chunk_ord becomes a long: document, section and place in it, in reading order."""
    parsed = written(manuals.sections(docs, {m: p for m, (p, _) in settings.units.items()}), "sections")
    rows = manuals.chunks(parsed)
    ord_ = F.expr("((chunk_ord.doc_ord * 100000 + chunk_ord.section_ord) * 4 + chunk_ord.kind_ord) * 100000 + chunk_ord.seq").alias("chunk_ord")
    kinds = docs.select("doc_ord", F.coalesce(F.col("doc_type") if "doc_type" in docs.columns else F.lit(None).cast("string"), F.lit("manual")).alias("doc_type"))
    typed = rows.withColumn("doc_ord", F.col("chunk_ord.doc_ord")).join(kinds, "doc_ord")
    chunks = written(typed.select(ord_, *[c for c in rows.columns if c != "chunk_ord"], "doc_type"), "chunks")
    frequencies = written(index.feature_frequencies(chunks), "features")
    n = chunks.count()
    vectors = written(index.hashed_vectors(index.tfidf(chunks, "chunk_ord", frequencies, n), "chunk_ord"), "vectors")
    return Index(chunks, vectors, frequencies, n, index.embedder_digest("native", "hashed", v.EMBEDDING_DIM, index.fit_digest(frequencies)) + "/" + index.content_digest(chunks))


def search(questions: DataFrame, idx: Index, settings: Settings) -> DataFrame:
    """questions: query_id, question, retrieval_query, f_unit, f_safety, and f_doc_type if chunks of one type of document only are wanted. (query_id, question, chunk_ord, text, ..., rrf, rerank, final, rank).

    A filter that is null (of unit and type also an empty one) is none; a chunk without the value fails any other.
    """
    branches = []
    asked = questions.select("query_id", F.col("retrieval_query").alias("question"), F.nullif(F.col("f_unit"), F.lit("")).alias("f_unit"), "f_safety", _type_filter(questions).alias("f_doc_type"))
    match = [("unit_model", "f_unit"), ("safety", "f_safety"), ("doc_type", "f_doc_type")]
    if settings.mode != "dense":
        branches += bm25.best(idx.chunks, asked, "chunk_ord", settings.pool, match=match)
    if settings.mode != "bm25":
        weights = index.tfidf(asked.withColumnRenamed("question", "text"), "query_id", idx.frequencies, idx.n)
        vectors = index.hashed_vectors(weights, "query_id").join(asked.select("query_id", "f_unit", "f_safety", "f_doc_type"), "query_id")
        held = idx.vectors.join(idx.chunks.select("chunk_ord", "unit_model", "safety", "doc_type"), "chunk_ord")
        branches.append(fusion.dense_top(held, vectors, "chunk_ord", "query_id", settings.pool, match=match))
    fused = fusion.reciprocal_ranks(branches, "chunk_ord", pool=settings.pool)
    pool = written(fused.join(idx.chunks, "chunk_ord").join(asked.select("query_id", "question"), "query_id"), "fused")
    if settings.reranker != "none":
        scored = bm25.pool_scores(pool, "query_id", "chunk_ord") if settings.reranker == "bm25" else providers.cross_encode(pool, providers.provider("cross-encoder", settings.cross_encoder))
        pool = fusion.blend(scored, "chunk_ord", top_k=settings.top_k if settings.truncate and settings.diversity is None else None)
    else:
        pool = pool.withColumn("rerank", F.lit(0.0)).withColumn("final", F.col("rrf")).withColumn("final_rank", F.col("rank")).where(F.col("rank") <= settings.top_k)
    pool = pool.drop("rank", "question").withColumnRenamed("final_rank", "rank").join(questions.select("query_id", "question"), "query_id")
    if settings.diversity is not None:
        chosen = fusion.diversify(pool.join(idx.vectors, "chunk_ord"), "chunk_ord", "query_id", settings.top_k, lam=settings.diversity)
        pool = pool.drop("rank").join(chosen, ["query_id", "chunk_ord"]).withColumnRenamed("mmr_rank", "rank")
    return pool


def _type_filter(questions: DataFrame) -> Column:
    return F.nullif(F.col("f_doc_type"), F.lit("")) if "f_doc_type" in questions.columns else F.lit(None).cast("string")


def trace(ranked: DataFrame, settings: Settings) -> DataFrame:
    """One row for each question of a search: mode, rrf_k, pool_size, and by chunk id the scores of fusion and rerank."""
    by_id = lambda score: F.map_from_entries(F.collect_list(F.struct("id", score)))
    once = ranked.groupBy("query_id", "id").agg(F.max("rrf").alias("rrf"), F.max("rerank").alias("rerank"))
    return once.groupBy("query_id").agg(F.lit(settings.mode).alias("mode"), F.lit(v.RRF_K).alias("rrf_k"), F.count(F.lit(1)).alias("pool_size"), by_id("rrf").alias("rrf"), by_id("rerank").alias("rerank"))


def _scope(questions: DataFrame, idx: Index, settings: Settings) -> Column:
    """What must be equal for a cached answer to hold: the filters, the mode and depth, and the index."""
    parts = [F.coalesce(F.trim("context_unit"), F.lit("")), F.coalesce(F.col("f_safety").cast("string"), F.lit("")), F.coalesce(_type_filter(questions), F.lit(""))]
    return F.concat_ws("\u0000", *parts, F.lit(settings.mode), F.lit(str(settings.top_k)), F.lit(idx.version))


def _question_vectors(questions: DataFrame, idx: Index) -> DataFrame:
    texts = questions.select("query_id", F.lower(F.trim("question")).alias("text"))
    return index.hashed_vectors(index.tfidf(texts, "query_id", idx.frequencies, idx.n), "query_id")


def cache_entries(questions: DataFrame, answers: DataFrame, idx: Index, settings: Settings) -> DataFrame:
    """Answers as cache for later questions: query_id, scope, embedding and the answer's columns. Answers that came from a cache aren't entered again.

    Entries of another index (of another version) never match, so an ingest makes a cache void.
    """
    own = questions.withColumn("scope", _scope(questions, idx, settings)).select("query_id", "scope")
    return own.join(_question_vectors(questions, idx), "query_id").join(answers.where("not cache_hit").select("query_id", *ANSWER), "query_id")


def ask(questions: DataFrame, idx: Index, settings: Settings, cache: DataFrame | None = None, threshold: float = v.SEMANTIC_CACHE) -> DataFrame:
    """questions: query_id, question, context_unit, f_safety (null: any), f_doc_type if wanted. One answer each: answer, citations, code_refs, escalation, escalation_topics, diagram_refs, cache_hit.

    Equal questions (without case and outer blanks, same filters) are answered once. cache (see cache_entries) answers the questions of which an
    entry of equal scope has cosine threshold or more: the most similar entry, and of equal ones the first.
    """
    if cache is not None:
        scoped = questions.withColumn("scope", _scope(questions, idx, settings))
        asked = _question_vectors(questions, idx).join(scoped.select("query_id", F.col("scope").alias("own")), "query_id")
        near = fusion.cached(cache.select(F.col("query_id").alias("entry"), "scope", "embedding"), asked, "entry", "query_id", [("scope", "own")], threshold)
        hits = written(near.join(cache.select(F.col("query_id").alias("entry"), *ANSWER), "entry"), "cached").drop("entry", "cosine")
        found = questions.join(hits, "query_id").withColumn("cache_hit", F.lit(True))
        return found.unionByName(ask(questions.join(hits.select("query_id"), "query_id", "left_anti"), idx, settings))
    same = [F.lower(F.trim("question")), F.coalesce("context_unit", F.lit("")), F.coalesce(F.col("f_safety").cast("string"), F.lit("")), F.coalesce(_type_filter(questions), F.lit(""))]
    # The first of equal questions is a partial aggregate, so a very common one does no harm.
    told_by = questions.select("query_id", F.struct(*same).alias("same"))
    told_by = told_by.join(told_by.groupBy("same").agg(F.min("query_id").alias("first_id")), "same").select("query_id", "first_id")
    keyed = questions.join(told_by, "query_id")
    first = keyed.where("query_id = first_id").drop("first_id")
    codes = idx.chunks.select(F.explode("code_anchors").alias("code"))
    analyzed = written(understand.analyze(first, codes, settings.units, context="context_unit").withColumn("f_unit", F.coalesce(F.nullif(F.col("context_unit"), F.lit("")), F.col("unit_model"))), "analyzed")
    fault_rows = idx.chunks.select("chunk_ord", F.explode("fault_rows").alias("f")).select("chunk_ord", "f.code", "f.cells")
    direct = written(understand.direct_hits(analyzed, idx.chunks, fault_rows), "direct")
    wanted = analyzed.join(direct.select("query_id").distinct(), "query_id", "left_anti") if settings.fast_path_only else analyzed
    ranked = written(search(wanted, idx, settings), "ranked")
    decided = written(compose.guardrail(analyzed, ranked, direct, settings.guardrail), "decided")
    calm = decided.where("not escalate").select("query_id")
    told = _answers(ranked.join(calm, "query_id", "left_semi"), direct.join(calm, "query_id", "left_semi"), analyzed, settings)
    told = calm.join(told, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(v.NOT_COVERED)))
    told = written(compose.with_exact_rows(told, direct), "told")
    cited = compose.citations(told.join(direct.select("query_id").distinct(), "query_id", "left_anti"), ranked).select("query_id", "chunk_ord", F.col("place").cast("int").alias("place"))
    cited = cited.union(direct.select("query_id", "chunk_ord", F.col("code_pos").cast("int")))
    near = written(compose.nearest_safety(analyzed, idx.chunks.select("chunk_ord", "text", "safety", "unit_model")), "near")
    cited = cited.join(calm, "query_id", "left_semi").union(near.join(decided.where("escalate"), "query_id", "left_semi").select("query_id", "chunk_ord", F.lit(1)))
    cited = written(cited, "cited")
    # A question about hazardous work cites a safety chunk in any case: the best by BM25, whatever its unit.
    meta = idx.chunks.select("chunk_ord", "id", "source_doc", "breadcrumb", "safety", "caption", "code_anchors", "image_ref")
    backed = cited.join(meta.where("safety"), "chunk_ord").select("query_id").distinct()
    lacking = analyzed.where("size(safety_topics) > 0").join(calm, "query_id", "left_semi").join(backed, "query_id", "left_anti")
    best = bm25.top(bm25.scores(idx.chunks, lacking.select("query_id", F.col("retrieval_query").alias("question")), "chunk_ord").join(idx.chunks.where("safety").select("chunk_ord"), "chunk_ord"), "bm25", "chunk_ord", 1)
    cited = cited.union(best.select("query_id", "chunk_ord", F.lit(1000)))
    full = cited.join(meta, "chunk_ord").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("chunk_id"), "source_doc", F.array_join(F.slice("breadcrumb", 2, 1000), " > ").alias("section_path"), "breadcrumb", "safety", "caption", "code_anchors", "image_ref"))).alias("citations"))
    section = near.join(meta, "chunk_ord").select("query_id", F.array_join(F.slice("breadcrumb", 2, 1000), " > ").alias("section"))
    warned = decided.where("escalate").join(analyzed.select("query_id", "f_unit"), "query_id").join(section, "query_id", "left").select("query_id", escalation_message(F.col("topics"), F.col("section"), F.col("f_unit")).alias("warning"))
    out = analyzed.select("query_id", "codes").join(decided, "query_id").join(told, "query_id", "left").join(warned, "query_id", "left").join(full, "query_id", "left")
    out = out.select(
        F.col("query_id").alias("first_id"),
        F.coalesce("warning", "answer").alias("answer"),
        "citations",
        F.col("codes").alias("code_refs"),
        F.col("escalate").alias("escalation"),
        F.when(F.col("escalate"), F.col("topics")).otherwise(F.array().cast("array<string>")).alias("escalation_topics"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("citations", lambda c: c["image_ref"])))).alias("diagram_refs"),
    )
    return keyed.join(out, "first_id").withColumn("cache_hit", F.col("query_id") != F.col("first_id")).drop("first_id")


def _answers(ranked: DataFrame, direct: DataFrame, analyzed: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, answer): by the model that settings name from the prompt of each question, else extracted."""
    if settings.llm is None:
        return compose.extractive_answer(ranked)
    asked = compose.prompt(ranked, direct).join(analyzed.select("query_id", "question"), "query_id")
    asked = asked.select("query_id", F.concat(F.lit("Context:\n"), F.array_join("blocks", "\n\n"), F.lit("\n\nQuestion: "), "question").alias("prompt"))
    return providers.complete(asked, providers.provider("llm", settings.llm)).select("query_id", "answer")


def run_eval(golden: DataFrame, idx: Index, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(items, report) of golden items: recall at k and over the pool, citations, groundedness, violations."""
    questions = golden.select(F.col("id").alias("query_id"), "question", F.lit(None).cast("string").alias("context_unit"), F.lit(None).cast("boolean").alias("f_safety"))
    numbered = written(questions.withColumn("query_id", F.xxhash64("query_id")), "questions")
    codes = idx.chunks.select(F.explode("code_anchors").alias("code"))
    analyzed = written(understand.analyze(numbered, codes, settings.units).withColumn("f_unit", F.col("unit_model")), "analyzed")
    pool = written(search(analyzed, idx, Settings(**{**settings.__dict__, "truncate": False, "diversity": None})), "pool")
    answers = written(ask(numbered, idx, settings), "answers")
    items = golden.withColumn("query_id", F.xxhash64("id"))
    found = evaluate.hit(F.col("code_anchors"), F.col("breadcrumb"), F.col("caption"), F.col("expected_code"), F.col("expected_section"))
    hits = pool.join(items.drop("question"), "query_id").groupBy("query_id").agg(F.bool_or(found & (F.col("rank") <= settings.top_k)).alias("recall_hit"), F.bool_or(found).alias("pool_hit"), F.collect_list(F.when(F.col("rank") <= v.PROMPT_BLOCKS, F.col("text"))).alias("contexts"))
    rows = items.join(answers.drop("question"), "query_id").join(hits, "query_id", "left")
    good = F.size(F.filter("citations", lambda c: evaluate.hit(c["code_anchors"], c["breadcrumb"], c["caption"], F.col("expected_code"), F.col("expected_section"))))
    safe_item = F.col("safety_relevant") | (F.col("capability") == "safety")
    backed = F.coalesce(F.exists("citations", lambda c: c["safety"]), F.lit(False))
    scored = rows.select(
        "id", "capability", F.coalesce("recall_hit", F.lit(False)).alias("recall_hit"), F.coalesce("pool_hit", F.lit(False)).alias("pool_hit"),
        F.coalesce(good, F.lit(0)).alias("citation_correct"), F.coalesce(F.size("citations"), F.lit(0)).alias("citation_total"),
        evaluate.groundedness(F.col("answer"), F.coalesce("contexts", F.array().cast("array<string>"))).alias("groundedness"),
        F.col("escalation").alias("escalated"), safe_item.alias("safety_item"), evaluate.violation(safe_item, F.col("escalation"), backed, F.col("answer")).alias("violation"),
    )
    return scored, evaluate.report(scored)
