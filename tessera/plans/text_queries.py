"""Queries of text functions and question understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import vocabulary as v
from tessera.operators import understand
from tessera.plans import sql
from tessera.plans.registry import query, strings, table

UNITS = {"T100": ("\\bT[ ]?-?100\\b", ["heat pump"]), "K7": ("\\bK[ ]?-?7\\b", ["chiller"])}
_ASKED = f"SELECT conv_id, turn, {sql.phrase('(conv_id + turn)')} || coalesce(text, '') AS question FROM conversations"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a question with a beginning of its own."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.expr(sql.phrase("(conv_id + turn)").replace("''", "\\'")), F.coalesce("text", F.lit(""))).alias("question"))


@query(f"SELECT doc_id, len(x)::BIGINT AS n_tokens, len(list_distinct(x))::BIGINT AS n_distinct, len({sql.content_tokens('text')})::BIGINT AS n_content FROM (SELECT doc_id, text, {sql.tokens('text')} AS x FROM documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", t.tokenize(F.col("text")).alias("x"))
    return docs.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"), F.size(t.content_tokens(F.col("text"))).cast("long").alias("n_content"))


@query(
    f"SELECT doc_id, sha256({sql.normalise('text')}) AS normalised, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'))::BIGINT AS n_numbers, len({sql.sentences('text')})::BIGINT AS n_sentences, "
    "regexp_matches(text, '(?i)\\b(not|never|no|cannot|can''t|don''t|do not|unsafe|prohibited)\\b') AS negates, len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]\\s+')) >= 3 AS procedural FROM documents"
)
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    told = lambda signal: F.when(text.isNotNull(), signal)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.normalise(text), 256).alias("normalised"), told(F.size(t.numbers(text)).cast("long")).alias("n_numbers"), F.size(t.sentences(text)).cast("long").alias("n_sentences"), told(t.negates(text)).alias("negates"), told(t.is_procedural(text)).alias("procedural"))


@query("SELECT h AS content_hash, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS h FROM documents) GROUP BY h")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT page_id, left(trim(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS s FROM pages)")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.slug(F.col("url")).alias("slug"))


@query(
    f"WITH a AS (SELECT conv_id, turn, {sql.content_tokens('text')} AS x FROM conversations) SELECT l.conv_id, l.turn, CASE WHEN len(l.x) = 0 OR len(r.x) = 0 THEN 0 ELSE "
    "round(len(list_intersect(l.x, r.x))::DOUBLE / len(list_distinct(list_concat(l.x, r.x))), 9) END AS jaccard FROM a l JOIN a r ON l.conv_id = r.conv_id AND r.turn = l.turn + 1"
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each turn to the next one of its conversation."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.content_tokens(F.col("text")).alias("x"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(t.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query(f"SELECT conv_id, turn, array_to_string({sql.topics('question')}, ',') AS topics FROM ({_ASKED})")
def safety_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(t.safety_topics(F.col("question")), ",").alias("topics"))


_SLANG_SQL = "flatten([" + ", ".join(f"CASE WHEN contains(low, '{k.replace(chr(39), chr(39) * 2)}') THEN {strings(x)} ELSE [] END" for k, x in v.SLANG.items()) + "])"
_SYNONYM_SQL = "flatten([" + ", ".join(f"CASE WHEN contains(padded, ' {k} ') THEN {strings(x)} ELSE [] END" for k, x in v.SYNONYMS.items()) + "])"


@query(
    f"WITH q AS (SELECT *, lower(question) AS low, ' ' || regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS padded FROM ({_ASKED})), e AS (SELECT conv_id, turn, list_concat({_SLANG_SQL}, {_SYNONYM_SQL}) AS terms FROM q) "
    "SELECT conv_id, turn, array_to_string(list_filter(terms, lambda x, i: list_position(terms, x) = i), '|') AS expansions FROM e"
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(understand.expansions(F.col("question")), "|").alias("expansions"))


_INTENT_SQL = "CASE " + " ".join(f"WHEN {sql.any_of('lower(question)', parts)} THEN '{name}'" for name, parts in v.INTENTS.items()) + " ELSE 'general' END"


@query(f"SELECT intent, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(upper(question), '(^|[^A-Z0-9_])E[ ]?-?(04|12)([^A-Z0-9_]|$)') THEN 'fault_lookup' ELSE {_INTENT_SQL} END AS intent FROM ({_ASKED})) GROUP BY intent")
def intent_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.lit(["E04", "E12"])
    asked = questions(spark, sf_dir).select(understand.intent(F.col("question"), F.arrays_overlap(understand.code_candidates(F.col("question")), known)).alias("intent"))
    return asked.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(question), '\\bt[ ]?-?100\\b') THEN 'T100' WHEN regexp_matches(lower(question), '\\bk[ ]?-?7\\b') THEN 'K7' WHEN contains(lower(question), 'heat pump') THEN 'T100' "
    f"WHEN contains(lower(question), 'chiller') THEN 'K7' ELSE role END AS unit_model FROM (SELECT q.*, c.role FROM ({_ASKED}) q JOIN conversations c USING (conv_id, turn))"
)
def unit_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).join(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return asked.select("conv_id", "turn", understand.detect_unit(F.col("question"), UNITS, F.col("role")).alias("unit_model"))


@query(
    f"SELECT p_partkey, ['E' || (p_partkey % 90 + 10), 'P' || (p_size + 100)] AS code_candidates FROM part"
)
def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Shows e "), F.col("p_partkey") % 90 + 10, F.lit(" then P-"), F.col("p_size") + 100, F.lit(" and R32, "), F.lower("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", understand.code_candidates(text).alias("code_candidates"))


@query(
    "WITH r AS (SELECT min(p_partkey) AS chunk_ord, 'E' || (p_partkey % 90 + 10) AS code, p_brand FROM part GROUP BY 2, 3), q AS (SELECT p_partkey AS query_id, 'E' || (p_partkey % 90 + 10) AS code, p_brand FROM part) "
    "SELECT q.query_id, 0::INT AS code_pos, q.code, q.p_brand AS unit_model, r.chunk_ord, 'Code: ' || q.code || ', Unit: ' || q.p_brand AS rendered_row FROM q JOIN r USING (code, p_brand)"
)
def fault_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part asks for its code; the registry has a row for each code and brand, with an empty cell that isn't rendered."""
    part = table(spark, sf_dir, "part").withColumn("code", F.concat(F.lit("E"), F.col("p_partkey") % 90 + 10))
    rows = part.groupBy("code", "p_brand").agg(F.min("p_partkey").alias("chunk_ord"))
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), value.alias("value"))
    fault_rows = rows.select("chunk_ord", "code", F.array(cell("Code", F.col("code")), cell("Note", F.lit("")), cell("Unit", F.col("p_brand"))).alias("cells"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("What does "), "code", F.lit(" mean?")).alias("question"), F.col("p_brand").alias("context"))
    analyzed = understand.analyze(asked, rows.select("code"), {}, context="context")
    return understand.direct_hits(analyzed, rows.select("chunk_ord", F.col("p_brand").alias("unit_model")), fault_rows)


@query("SELECT upper(code) AS code, list(p_partkey ORDER BY p_partkey) AS chunk_ords FROM (SELECT p_partkey, unnest(list_distinct(['e' || (p_partkey % 90 + 10), 'P' || p_size])) AS code FROM part) GROUP BY 1")
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = F.array_distinct(F.array(F.concat(F.lit("e"), F.col("p_partkey") % 90 + 10), F.concat(F.lit("P"), F.col("p_size"))))
    return understand.code_map(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_ord"), anchors.alias("code_anchors")))


@query("SELECT DISTINCT code FROM (SELECT unnest(['E' || (p_partkey % 90 + 10), 'R32', regexp_extract(p_brand, '[0-9]+')]) AS code FROM part) WHERE code LIKE 'E%' OR code = 'R32'")
def document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct code-like strings of texts made from the parts; documents have none."""
    text = F.concat(F.lit("shows E"), F.col("p_partkey") % 90 + 10, F.lit(" with R32, not e04 or "), F.lower("p_brand"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z]{1,3}[0-9]{2,3}"), F.lit(0)))
    return table(spark, sf_dir, "part").select(F.explode(found).alias("code")).distinct()
