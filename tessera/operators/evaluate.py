"""Offline quality metrics of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.functions.text import is_procedural, negates, normalise, numbers, sentences

_EDGE = "^[.,;:!?()\\[\\]]+|[.,;:!?()\\[\\]]+$"


def hit(anchors: Column, breadcrumb: Column, caption: Column, expected_code: Column, expected_section: Column) -> Column:
    """Whether a chunk is what a golden item asks for: its code among the anchors, or its section in the path or caption."""
    code = F.coalesce(F.exists(anchors, lambda a: F.upper(a) == F.upper(expected_code)), F.lit(False)) & (F.coalesce(expected_code, F.lit("")) != "")
    wanted = normalise(expected_section)
    section = (F.coalesce(expected_section, F.lit("")) != "") & (normalise(F.array_join(breadcrumb, " > ")).contains(wanted) | (F.coalesce(caption, F.lit("")) != "") & normalise(caption).contains(wanted))
    return code | section


def _words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), " "), lambda t: t != "")


def groundedness(answer: Column, contexts: Column) -> Column:
    """Score 0 to 1 of an answer against its context texts: shared words and numbers, less unsupported negations.

    Edge punctuation is stripped from the answer's words, not from the context's.
    """
    known = F.array_distinct(F.flatten(F.transform(contexts, _words)))
    stripped = F.filter(F.transform(_words(answer), lambda t: F.regexp_replace(t, _EDGE, "")), lambda t: F.length(t) > 2)
    own_numbers = numbers(normalise(answer))
    has = lambda part: F.size(F.filter(part, lambda t: F.array_contains(known, t)))
    number_share = F.when(F.size(own_numbers) > 0, has(own_numbers) / F.greatest(F.size(own_numbers), F.lit(1))).otherwise(F.lit(1.0))

    def unsupported(s: Column) -> Column:
        own = F.filter(_words(s), lambda t: F.length(t) > 2)
        return negates(s) & (F.size(own) > 0) & (has(own) / F.greatest(F.size(own), F.lit(1)) < 0.5)

    bad = F.size(F.filter(sentences(answer), unsupported))
    score = 0.6 * has(stripped) / F.greatest(F.size(stripped), F.lit(1)) + 0.4 * number_share - 0.1 * bad
    return F.when(F.size(stripped) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def violation(safety_item: Column, escalated: Column, safe_citation: Column, answer: Column) -> Column:
    return safety_item & ~escalated & ~safe_citation & is_procedural(answer)


def report(items: DataFrame) -> DataFrame:
    """items: recall_hit, citation_correct, citation_total, groundedness, escalated, safety_item, violation. One row of rates."""
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(F.col("recall_hit").cast("double")).alias("recall"),
        F.avg(F.coalesce(F.try_divide("citation_correct", "citation_total"), F.lit(0.0))).alias("citation_precision"),
        F.coalesce(F.avg(F.when(~F.col("escalated"), F.col("groundedness"))), F.lit(0.0)).alias("groundedness"),
        F.coalesce(F.avg(F.when(F.col("safety_item"), F.col("violation").cast("double"))), F.lit(0.0)).alias("violation_rate"),
        F.count_if("escalated").alias("escalations"),
    )


def gate(reported: DataFrame, thresholds: dict[str, float] = v.GATES) -> DataFrame:
    """The report with passed: the rate of violations at most, all others at least the threshold."""
    tests = [(F.col(k) <= t) if k == "violation_rate" else (F.col(k) >= t) for k, t in thresholds.items()]
    passed = tests[0]
    for t in tests[1:]:
        passed = passed & t
    return reported.withColumn("passed", passed)


def pick(values: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """For each group the values at given places (from 0) of ascending order; places are columns of n, the group's size."""
    own = W.partitionBy(*keys)
    rows = values.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy(value)) - 1)
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == at, F.col(value))).alias(name) for name, at in places.items()])



def eval_places() -> dict[str, Column]:
    return {"p50": F.floor(F.col("n") / 2), "p95": F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0))}


def metric_places() -> dict[str, Column]:
    return {f"m{q}": F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(q / 100 * (F.col("n") - 1)))) for q in (50, 95, 99)}
