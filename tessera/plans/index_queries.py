"""Queries of parsing, chunking and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import index, manuals
from tessera.plans import sql
from tessera.plans.registry import query, table
from tessera.sources.steps import folder
from tessera.streaming.ingest import ingest, latest

UNITS = {"T100": r"\bT\s?-?100\b", "K7": r"\bK\s?-?7\b"}

#: A manual for each nation: its suppliers are the rows of a fault table, its name goes into headings, a procedure and warnings.
_MANUAL = (
    "concat('# Manual of ', n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' T-100' ELSE ' K7' END, '\nRevision 3.1 of the text\n', "
    "'## Overview\nThe unit of ', n_name, ' is described here in a few plain words.\n\n### Care\nKeep it dry, and look at it once a year at least.\n', "
    "'## Safety first\nWARNING: stay away from ', n_name, '\n### Inner part\nNothing to add but a line that is long enough.\n', "
    "'## Fault codes\nTable: Faults of ', n_name, '\n| Code | Supplier | Note |\n|---|:--|---|\n', faults, '\n\n![view](img/', n_name, '.png)\n', "
    "'## Start up\nFirst line.\nSecond line.\n1. Open it\n2. Look\n   twice\n3. Close it\n4. Wait\n5. Go on\n6) Stop\n')"
)


def nation_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_doc, doc_ord, text) of each nation."""
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.concat(F.lit("| E"), s["s_suppkey"] % 90 + 10, F.lit(" | "), s["s_name"], F.lit(" | |"))), "\n").alias("faults"))
    joined = table(spark, sf_dir, "nation").join(rows, "n_nationkey", "left").withColumn("faults", F.coalesce("faults", F.lit("")))
    return joined.select(F.concat(F.lit("nation_"), "n_nationkey", F.lit(".md")).alias("source_doc"), F.col("n_nationkey").cast("long").alias("doc_ord"), F.expr(_MANUAL.replace("\n", "\\n")).alias("text"))


def nation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuals.chunks(manuals.sections(nation_manuals(spark, sf_dir), UNITS))


@query(
    "SELECT n_nationkey::BIGINT AS doc_ord, i AS section_ord, unit_model, title, parent, safety FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'T100' ELSE 'K7' END AS unit_model, unnest([0, 1, 2, 3, 4, 5])::INT AS i, "
    "unnest(['Overview', 'Care', 'Safety first', 'Inner part', 'Fault codes', 'Start up']) AS title, unnest([NULL, 0, NULL, 2, NULL, NULL])::INT AS parent, unnest([false, false, true, true, false, false]) AS safety FROM nation)"
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = manuals.sections(nation_manuals(spark, sf_dir), UNITS)
    return parsed.select("doc_ord", "section_ord", "unit_model", "title", F.col("parent_ord").alias("parent"), "safety")


@query(
    "SELECT s_nationkey::BIGINT AS doc_ord, 'E' || (s_suppkey % 90 + 10) AS code, arg_max(s_name, s_suppkey) AS supplier, 'Faults of ' || any_value(n_name) AS caption FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"
)
def table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of the fault tables; of a repeated code the last row."""
    parsed = manuals.sections(nation_manuals(spark, sf_dir), UNITS)
    each = parsed.select("doc_ord", F.explode("tables").alias("t")).select("doc_ord", "t.caption", F.explode("t.fault_rows").alias("f"))
    return each.select("doc_ord", "f.code", F.get("f.cells", F.lit(1))["value"].alias("supplier"), "caption")


@query(
    "SELECT n_nationkey::BIGINT AS doc_ord, unnest(['section', 'section', 'section', 'section', 'table', 'image', 'section', 'steps', 'steps']) AS chunk_type, 'nation-' || n_nationkey || unnest([':overview:sec', ':overview:care:sec', ':safety-first:sec', ':safety-first:inner-part:sec', ':fault-codes:table', ':fault-codes:image', ':start-up:sec', ':start-up:step-1-4:steps', ':start-up:step-5-6:steps']) AS id, "
    "unnest([false, false, true, true, false, false, false, false, false]) AS safety FROM nation"
)
def chunk_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_chunks(spark, sf_dir).select(F.col("chunk_ord.doc_ord").alias("doc_ord"), "chunk_type", "id", "safety")


@query()
def long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of lines of every document; each group begins with the last line of the one before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(manuals.paragraph_groups(F.coalesce("text", F.lit("")), separator="\n")).alias("part", "text"))
    return docs.select("doc_id", "part", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


_NEW = "SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(text) ELSE text END AS text FROM documents WHERE lang <> 'es'"
_HASH = "sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')))"


@query(
    f"WITH o AS (SELECT doc_id, {_HASH} AS h FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' old' ELSE text END AS text FROM documents WHERE lang <> 'de')), n AS (SELECT doc_id, {_HASH} AS h FROM ({_NEW})), "
    "d AS (SELECT CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS state FROM n FULL JOIN o USING (doc_id)) "
    "SELECT count(*) FILTER (state <> 'removed') AS total_chunks, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'updated') AS updated, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state IN ('new', 'updated')) AS re_embedded FROM d"
)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two snapshots: Spanish documents went, German ones came, French ones changed in more than case."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang <> 'de'").select("doc_id", content_hash(F.when(F.col("lang") == "fr", F.concat("text", F.lit(" old"))).otherwise(F.col("text"))).alias("content_hash"))
    new = docs.where("lang <> 'es'").select("doc_id", content_hash(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))).alias("content_hash"))
    return index.statistics(index.difference(new, old, "doc_id"))


_FEATURES = f"SELECT conv_id, turn, unnest(flatten(list_transform({sql.tokens('text')}, lambda w: list_concat(['w:' || w], flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(w) + 2 >= n THEN list_transform(range(1, length(w) + 4 - n), lambda i: 'g:' || substring('↑' || w || '↓', i, n)) ELSE [] END)))))) AS feature FROM conversations"


@query(
    f"WITH f AS ({_FEATURES}), tf AS (SELECT conv_id, turn, feature, count(*) AS tf FROM f GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature), n AS (SELECT count(*) AS n FROM conversations) "
    "SELECT conv_id, turn, count(*) AS n_features, round(sum((1 + ln(tf)) * (ln((n + 1)::DOUBLE / (df + 1)) + 1)), 6) AS weight FROM tf JOIN df USING (feature), n GROUP BY conv_id, turn"
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every turn: how many, and the sum of their weights."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    weights = index.tfidf(turns, "key", index.feature_frequencies(turns), turns.count())
    return weights.groupBy("key").agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("weight"), 6).alias("weight")).select("key.conv_id", "key.turn", "n_features", "weight")


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    weights = index.tfidf(turns, "key", index.feature_frequencies(turns), turns.count())
    return index.hashed_vectors(weights, "key").select("key.conv_id", "key.turn", "embedding")


@query(f"SELECT doc_id AS id, {_HASH} AS content_hash FROM documents")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files into an incremental table, twice; the second run finds nothing new."""
    out = folder(spark, "ingest")
    schema = table(spark, sf_dir, "documents").schema
    for run in ("first", "second"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parque[t]").select(F.col("doc_id").alias("id"), "text")
        ingest(stream, out, folder(spark, run)).awaitTermination()
    return latest(spark.read.parquet(out), "id").select("id", "content_hash")


@query(f"SELECT doc_id AS id, {_HASH} AS content_hash FROM documents")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark, "snapshot")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content_hash(F.col("text")).alias("content_hash"))
    index.save_snapshot(docs.where("id < 0"), place)
    index.save_snapshot(docs, place)
    return index.load_snapshot(spark, place)
