"""Queries of guardrail, answers, citations, metrics and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.operators import compose, evaluate
from tessera.plans import service, sql
from tessera.plans.index_queries import UNITS, nation_manuals
from tessera.plans.registry import query, table
from tessera.plans.text_queries import _ASKED, questions


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a question, the later turns of its conversation as ranked chunks; system turns stand for safety sections."""
    asked = questions(spark, sf_dir).select(F.struct("conv_id", "turn").alias("query_id"), "question")
    later = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("chunk_ord"), "text", (F.col("role") == "system").alias("safety"))
    pairs = asked.join(later, (F.col("query_id.conv_id") == F.col("c")) & (F.col("chunk_ord") > F.col("query_id.turn")) & (F.col("chunk_ord") <= F.col("query_id.turn") + v.PROMPT_BLOCKS))
    return pairs.withColumn("rank", (F.col("chunk_ord") - F.col("query_id.turn")).cast("int")).drop("c")


_NEXT = f"nx AS (SELECT a.conv_id, a.turn, a.question, c.text FROM ({_ASKED}) a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1)"
_QUOTES = f"sen AS (SELECT conv_id, turn, {sql.content_tokens('question')} AS q, s, i FROM (SELECT conv_id, turn, question, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT *, {sql.sentences('text')} AS l FROM nx))), quo AS (SELECT conv_id, turn, trim(s) AS sentence, len(list_intersect(q, {sql.content_tokens('s')})) AS overlap, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect(q, {sql.content_tokens('s')})) DESC, i) AS n FROM sen QUALIFY n <= 4 AND overlap > 0)"


@query(f"WITH {_NEXT}, {_QUOTES} SELECT conv_id, turn, sentence, overlap::INT AS overlap, n::INT AS n FROM quo")
def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each next turn the sentences that share most words with the question."""
    out = compose.quotes(turns(spark, sf_dir).where("rank = 1"), ["query_id"])
    return out.select("query_id.conv_id", "query_id.turn", "sentence", "overlap", "n")


_ASK = v.PROCEDURAL_ASK.replace("'", "''")


@query(
    f"WITH {_NEXT}, {_QUOTES}, qt AS (SELECT conv_id, turn, list_distinct(flatten(list({sql.topics('sentence')}))) AS t FROM quo GROUP BY ALL), "
    f"sup AS (SELECT a.conv_id, a.turn, bool_or(c.role = 'system') AS s FROM conversations a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn > a.turn AND c.turn <= a.turn + {v.GUARDRAIL_WINDOW} GROUP BY ALL), "
    f"de AS (SELECT a.conv_id, a.turn, list_sort(list_distinct(list_concat({sql.topics('question')}, CASE WHEN regexp_matches(question, '{_ASK}') THEN coalesce(t, []) ELSE [] END))) AS topics, coalesce(s, false) AS s FROM ({_ASKED}) a LEFT JOIN qt USING (conv_id, turn) LEFT JOIN sup USING (conv_id, turn)) "
    "SELECT conv_id, turn, len(topics) > 0 AND NOT s AS escalate, array_to_string(topics, ',') AS topics FROM de"
)
def guardrail_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select(F.struct("conv_id", "turn").alias("query_id"), "question")
    out = compose.guardrail(asked, turns(spark, sf_dir))
    return out.select("query_id.conv_id", "query_id.turn", "escalate", F.array_join("topics", ",").alias("topics"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.extractive_answer(turns(spark, sf_dir)).select("query_id.conv_id", "query_id.turn", "answer")


@query(
    f"WITH p AS (SELECT a.conv_id, a.turn, c.turn AS chunk_ord, c.turn - a.turn AS rank, len(list_intersect({sql.content_tokens('a.text')}, {sql.content_tokens('c.text')}))::DOUBLE / greatest(len({sql.content_tokens('a.text')}), 1) AS share FROM conversations a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn > a.turn AND c.turn <= a.turn + {v.PROMPT_BLOCKS}), "
    f"o AS (SELECT *, max(share) OVER w AS most, row_number() OVER (PARTITION BY conv_id, turn ORDER BY share DESC, rank) AS place FROM p WINDOW w AS (PARTITION BY conv_id, turn)) SELECT conv_id, turn, chunk_ord, place::INT AS place, round(share, 9) AS share FROM o WHERE place <= {v.CITATIONS} AND CASE WHEN most >= {v.CITATION_COVERAGE} THEN share >= {v.CITATION_COVERAGE} ELSE place = 1 END"
)
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as an answer, the later turns as what it may cite."""
    answers = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))
    return compose.citations(answers, turns(spark, sf_dir)).select("query_id.conv_id", "query_id.turn", "chunk_ord", "place", "share")


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[.,;:!?()\\[\\]]+', ''), '[.,;:!?()\\[\\]]+$', '')"


_WORDS = lambda x: f"list_filter(string_split({sql.normalise(x)}, ' '), lambda t: t <> '')"
_NEG = v.NEGATION.replace("'", "''")


@query(
    f"WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, list_distinct({_WORDS('b.text')}) AS known FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), "
    f"w AS (SELECT *, list_filter(list_transform({_WORDS('answer')}, lambda t: {_strip('t')}), lambda t: length(t) > 2) AS own, list_transform(regexp_extract_all({sql.normalise('answer')}, '[0-9]+(?:[.,][0-9]+)?'), lambda n: replace(n, ',', '.')) AS nums FROM p), "
    f"s AS (SELECT *, len(list_filter({sql.sentences('answer')}, lambda s: regexp_matches(s, '{_NEG}') AND len(list_filter({_WORDS('s')}, lambda t: length(t) > 2)) > 0 AND len(list_filter({_WORDS('s')}, lambda t: length(t) > 2 AND list_contains(known, t)))::DOUBLE / greatest(len(list_filter({_WORDS('s')}, lambda t: length(t) > 2)), 1) < 0.5)) AS bad FROM w) "
    "SELECT conv_id, turn, CASE WHEN len(own) = 0 THEN 0 ELSE round(greatest(0, least(1, 0.6::DOUBLE * len(list_filter(own, lambda t: list_contains(known, t))) / len(own) + 0.4::DOUBLE * CASE WHEN len(nums) > 0 THEN len(list_filter(nums, lambda t: list_contains(known, t)))::DOUBLE / len(nums) ELSE 1 END - 0.1::DOUBLE * bad)), 6) END AS groundedness FROM s"
)
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an answer, the next one as its context."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluate.groundedness(F.col("text"), F.array("context")), 6).alias("groundedness"))


_ITEMS = "SELECT quality = 1 AS recall_hit, toxic AS citation_correct, quality + toxic AS citation_total, (doc_id % 101) / 100.0::DOUBLE AS groundedness, toxic = 1 AS escalated, quality = 0 AS safety_item, toxic = 0 AND quality = 0 AS violation FROM labels"


@query(
    f"WITH r AS (SELECT count(*) AS items, avg(recall_hit::INT) AS recall, avg(coalesce(citation_correct::DOUBLE / nullif(citation_total, 0), 0)) AS citation_precision, coalesce(avg(groundedness) FILTER (NOT escalated), 0) AS groundedness, coalesce(avg(violation::INT) FILTER (safety_item), 0) AS violation_rate, count(*) FILTER (escalated) AS escalations FROM ({_ITEMS})) "
    "SELECT items, round(recall, 9) AS recall, round(citation_precision, 9) AS citation_precision, round(groundedness, 9) AS groundedness, round(violation_rate, 9) AS violation_rate, escalations, recall >= 0.75 AND citation_precision >= 0.8 AND groundedness >= 0.6 AND violation_rate <= 0 AS passed FROM r"
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the outcomes of a golden set."""
    items = table(spark, sf_dir, "labels").selectExpr("quality = 1 AS recall_hit", "toxic AS citation_correct", "quality + toxic AS citation_total", "doc_id % 101 / 100D AS groundedness", "toxic = 1 AS escalated", "quality = 0 AS safety_item", "toxic = 0 AND quality = 0 AS violation")
    out = evaluate.gate(evaluate.report(items))
    return out.select("items", *[F.round(c, 9).alias(c) for c in ("recall", "citation_precision", "groundedness", "violation_rate")], "escalations", "passed")


@query(
    "WITH o AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events WHERE value > 0) SELECT event_type, any_value(n) AS n, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = greatest((n * 0.95::DOUBLE)::BIGINT - CASE WHEN (n * 0.95::DOUBLE)::BIGINT > n * 0.95::DOUBLE THEN 1 ELSE 0 END - 1, 0)) AS p95, "
    "max(value) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS m50, max(value) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS m95, max(value) FILTER (i = round_even(0.99::DOUBLE * (n - 1), 0)) AS m99 FROM o GROUP BY event_type"
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").where("value > 0").select("event_type", "value")
    return evaluate.pick(values, ["event_type"], "value", {**evaluate.eval_places(), **evaluate.metric_places()})


@query("SELECT conv_id, turn, first_value(conv_id || '/' || turn) OVER (PARTITION BY role, lower(trim(text)) ORDER BY conv_id, turn) AS answered_by FROM conversations")
def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of the same role and text, without case and outer blanks, answers the others."""
    keyed = table(spark, sf_dir, "conversations").withColumn("q", F.lower(F.trim("text")))
    # The least turn is a partial aggregate, so a very common question does no harm.
    first = keyed.groupBy("role", "q").agg(F.min(F.struct("conv_id", "turn")).alias("f")).select("role", "q", F.concat_ws("/", F.col("f.conv_id").cast("string"), F.col("f.turn").cast("string")).alias("answered_by"))
    return keyed.join(first, ["role", "q"]).select("conv_id", "turn", "answered_by")


@query(
    "WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+\\s*') AS l FROM conversations), e AS (SELECT conv_id, turn, unnest(range(len(l) + 2)) AS seq, l FROM t) "
    "SELECT conv_id, turn, seq::INT AS seq, CASE WHEN seq = 0 THEN 'meta' WHEN seq <= len(l) THEN 'token' ELSE 'done' END AS event, CASE WHEN seq > 0 AND seq <= len(l) THEN l[seq] ELSE '' END AS data FROM e"
)
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as an answer that is streamed."""
    answers = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))
    return compose.events(answers).select("query_id.conv_id", "query_id.turn", "seq", "event", "data")


def _settings() -> service.Settings:
    return service.Settings(units={m: (p, {"T100": ["heat pump"], "K7": ["chiller"]}[m]) for m, p in UNITS.items()})


@query()
def ask_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine: an index of the nations' manuals answers a question of each nation and each distinct beginning of turns."""
    idx = service.build(nation_manuals(spark, sf_dir), _settings())
    nation = table(spark, sf_dir, "nation")
    asked = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("What does the manual of "), "n_name", F.lit(" say about code E11 and the start up steps?")).alias("question"))
    asked = asked.union(spark.createDataFrame([(1000 + i, p) for i, p in enumerate(sql.PHRASES)], "query_id long, question string"))
    questions_ = asked.withColumn("context_unit", F.lit(None).cast("string")).withColumn("f_safety", F.lit(None).cast("boolean"))
    out = service.ask(questions_, idx, _settings())
    return out.select("query_id", "answer", F.transform("citations", lambda c: c["chunk_id"]).alias("cited"), "code_refs", "escalation", "escalation_topics", "cache_hit")


@query()
def eval_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set about the nations' manuals, and its report."""
    idx = service.build(nation_manuals(spark, sf_dir), _settings())
    nation = table(spark, sf_dir, "nation")
    golden = nation.select(F.concat(F.lit("g"), "n_nationkey").alias("id"), F.concat(F.lit("Which overview describes the unit of "), "n_name", F.lit("?")).alias("question"), F.lit("overview").alias("expected_section"), F.lit(None).cast("string").alias("expected_code"), F.lit("general").alias("capability"), F.lit(False).alias("safety_relevant"))
    return evaluate.gate(service.run_eval(golden, idx, _settings())[1])
