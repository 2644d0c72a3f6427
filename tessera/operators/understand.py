"""Understanding of questions: expansions, codes, unit, intent, topics, and exact rows of fault tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.functions.text import any_substring, render_row, safety_topics

#: Units by model: (pattern that names it, words that imply it). Given by the caller, in order of precedence.
Units = Mapping[str, tuple[str, Sequence[str]]]


def _low(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def _fired(condition, table: Mapping[str, list[str]]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(condition(key), F.array(*map(F.lit, terms))).otherwise(none) for key, terms in table.items()])


def slang_terms(question: Column, table: Mapping[str, list[str]] = v.SLANG) -> Column:
    """Terms of every slang phrase that is a substring of the question, in the table's order."""
    low = _low(question)
    return _fired(lambda phrase: low.contains(phrase), table)


def synonym_terms(question: Column, table: Mapping[str, list[str]] = v.SYNONYMS) -> Column:
    """Terms of every word that the question has as a whole word."""
    low = F.concat(F.lit(" "), F.regexp_replace(_low(question), "[^\\p{L}\\p{N}_]+", " "), F.lit(" "))
    return _fired(lambda word: low.contains(f" {word} "), table)


def expansions(question: Column) -> Column:
    return F.array_distinct(F.concat(slang_terms(question), synonym_terms(question)))


def retrieval_query(question: Column, terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.concat_ws(" ", question, F.array_join(terms, " "))).otherwise(question)


def code_candidates(question: Column, unit_tokens: Sequence[str] = ()) -> Column:
    """Codes of a letter and two or three digits in order, but for letter R (designations) and unit names."""
    up, p = F.upper(F.coalesce(question, F.lit(""))), F.lit(v.QUERY_CODE)
    codes = F.zip_with(F.regexp_extract_all(up, p, F.lit(1)), F.regexp_extract_all(up, p, F.lit(2)), lambda a, b: F.concat(a, b))
    return F.filter(codes, lambda c: ~c.startswith("R") & ~c.isin(list(unit_tokens)) if unit_tokens else ~c.startswith("R"))


def detect_unit(question: Column, units: Units, context: Column | None = None) -> Column:
    """A named unit first, then one that a word implies, then the caller's."""
    low = _low(question)
    named = [F.when(low.rlike("(?i)" + pattern), F.lit(model)) for model, (pattern, _) in units.items()]
    implied = [F.when(any_substring(low, list(nouns)), F.lit(model)) for model, (_, nouns) in units.items() if nouns]
    return F.coalesce(*named, *implied, context if context is not None else F.lit(None).cast("string"))


def intent(question: Column, has_codes: Column) -> Column:
    low = _low(question)
    rest = reduce(lambda out, item: F.when(any_substring(low, item[1]), F.lit(item[0])).otherwise(out), reversed(list(v.INTENTS.items())), F.lit("general"))
    return F.when(has_codes, F.lit("fault_lookup")).otherwise(rest)


def analyze(questions: DataFrame, codes: DataFrame, units: Units, question: str = "question", context: str | None = None) -> DataFrame:
    """questions with expansions, retrieval_query, code_candidates, codes (those in the table codes(code), in order), unit_model, safety_topics, intent."""
    out = questions.withColumn("expansions", expansions(F.col(question)))
    out = out.withColumn("retrieval_query", retrieval_query(F.col(question), F.col("expansions"))).withColumn("code_candidates", code_candidates(F.col(question), list(units)))
    out = out.withColumn("_row", F.monotonically_increasing_id())
    listed = out.select("_row", F.posexplode("code_candidates").alias("pos", "code")).join(codes.select(F.upper("code").alias("code")).distinct(), "code", "left_semi")
    valid = listed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c")).select("_row", F.col("c.code").alias("codes"))
    out = out.join(valid, "_row", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).drop("_row")
    out = out.withColumn("unit_model", detect_unit(F.col(question), units, F.col(context) if context else None))
    return out.withColumn("safety_topics", safety_topics(F.col(question))).withColumn("intent", intent(F.col(question), F.size("codes") > 0))


def code_map(chunks: DataFrame) -> DataFrame:
    """(code, chunk_ords): the chunks of each code in index order."""
    each = chunks.select("chunk_ord", F.explode("code_anchors").alias("code"))
    return each.groupBy(F.upper("code").alias("code")).agg(F.array_sort(F.collect_list("chunk_ord")).alias("chunk_ords"))


def direct_hits(analyzed: DataFrame, chunks: DataFrame, fault_rows: DataFrame, query_key: str = "query_id") -> DataFrame:
    """For each known code of a question the first chunk of its unit (or of none) with a registry row: (query_key, code_pos, code, unit_model, chunk_ord, rendered_row).

    fault_rows: (chunk_ord, code, cells array of (col, value)).
    """
    asked = analyzed.select(query_key, F.col("unit_model").alias("asked_unit"), F.posexplode("codes").alias("code_pos", "code"))
    rows = chunks.select("chunk_ord", "unit_model").join(fault_rows.select("chunk_ord", F.upper("code").alias("code"), "cells"), "chunk_ord")
    found = asked.join(rows, "code").where("unit_model is null or asked_unit is null or unit_model = asked_unit")
    order = W.partitionBy(query_key, "code_pos").orderBy("chunk_ord")
    best = found.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select(query_key, "code_pos", "code", "unit_model", "chunk_ord", render_row(F.col("cells")).alias("rendered_row"))
