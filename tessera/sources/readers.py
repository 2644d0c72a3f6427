"""Readers and writers of manuals, golden sets, images, PDF pages and reports, all through Spark's file sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GOLDEN = "id string, question string, expected_section string, expected_code string, capability string, safety_relevant boolean"


def manuals(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source_doc, doc_ord, text) of a folder's files, not of its subfolders, in order of their names."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source_doc"), F.col("value").alias("text"))
    # Names alone are ordered: a narrow table with one row a file.
    order = files.select("source_doc").withColumn("doc_ord", F.row_number().over(W.orderBy("source_doc")).cast("long") - 1)
    return files.join(order, "source_doc").select("source_doc", "doc_ord", "text")


def inline_manuals(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(n, i, t) for i, (n, t) in enumerate(sorted(texts.items()))], "source_doc string, doc_ord long, text string")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON-lines file; capability is general and safety_relevant false where missing."""
    rows = spark.read.schema(GOLDEN).json(path).where("id is not null")
    return rows.withColumn("capability", F.coalesce("capability", F.lit("general"))).withColumn("safety_relevant", F.coalesce("safety_relevant", F.lit(False)))


def images(spark: SparkSession, folder: str, units: dict[str, list[str]]) -> DataFrame:
    """(path, unit_model, status): the first unit of which a mark is in the file's name or first 4,096 bytes."""
    files = spark.read.format("binaryFile").load(folder)
    seen = F.lower(F.concat_ws(" ", F.regexp_extract("path", "[^/]*$", 0), F.decode(F.substring("content", 1, 4096), "ISO-8859-1")))
    unit: Column = F.lit(None).cast("string")
    for model, marks in reversed(list(units.items())):
        found = F.lit(False)
        for mark in marks:
            found = found | seen.contains(mark.lower())
        unit = F.when(found, F.lit(model)).otherwise(unit)
    return files.select("path", unit.alias("unit_model")).withColumn("status", F.when(F.col("unit_model").isNull(), F.lit("unreadable")).otherwise(F.lit("identified")))


def pdf_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, number, text) of each page, numbers from 1. extract: a file's bytes to its pages' texts, by whichever PDF library is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, c in batch.itertuples(index=False) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "number", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content").mapInPandas(run, "path string, number int, text string")


def pdf_images(spark: SparkSession, folder: str, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(name, content) of each page as an image, named after file and page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{re.sub(r'.*/|\\.pdf$', '', p)}_p{i:03d}.png", x) for p, c in batch.itertuples(index=False) for i, x in enumerate(render(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["name", "content"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content").mapInPandas(run, "name string, content binary")


def to_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, schema) -> DataFrame:
    """Rows of (json) by a schema; a text that is no such object fails, as it isn't one of to_json's."""
    return df.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def manifest(docs: DataFrame) -> DataFrame:
    """(source_doc, sha256) of texts."""
    return docs.select("source_doc", F.sha2("text", 256).alias("sha256"))


def report_markdown(report: DataFrame, items: DataFrame) -> DataFrame:
    """One row (markdown): the rates and a line for each item."""
    rates = [c for c, t in report.dtypes if t in ("double", "bigint")]
    head = F.concat_ws("\n", F.lit("# Evaluation"), F.lit(""), F.lit("| metric | value |"), F.lit("|---|---|"), *[F.format_string(f"| {c} | %s |", F.col(c).cast("string")) for c in rates])
    line = F.format_string("| %s | %s | %s |", "id", F.col("recall_hit").cast("string"), F.format_number("groundedness", 2))
    body = items.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return report.select(head.alias("head")).crossJoin(body).select(F.concat("head", F.lit("\n\n| id | hit | groundedness |\n|---|---|---|\n"), "body").alias("markdown"))
