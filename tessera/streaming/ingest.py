"""Incremental ingest and replay protection as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import content_hash


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "id", once: bool = True, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends the stream's rows that are new or changed to the Parquet folder table, with content_hash and version (the batch's number).

    The newest version of a key is its row; latest() reads them. A batch that runs again finds what it wrote before and writes nothing twice.
    prepare makes the rows of a batch, such as chunks of documents; rows that a later batch doesn't make again stay.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = batch if prepare is None else prepare(batch)
        rows = made.withColumn("content_hash", content_hash(F.col("text"))).dropDuplicates([key, "content_hash"]).withColumn("version", F.lit(number).cast("long"))
        try:
            old = latest(spark.read.parquet(table), key).select(key, "content_hash")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = None
        changed = rows if old is None else rows.join(old, [key, "content_hash"], "left_anti")
        changed.write.mode("append").parquet(table)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(table: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each key."""
    newest = table.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), "version").alias("r"))
    return newest.select(key, "r.*")


def once_only(stream: DataFrame, key: str, body: str, time: str, within: str = "1 hour") -> DataFrame:
    """Requests without the repeats of equal key and body inside the watermark; state is dropped as it passes."""
    digest = F.sha2(F.concat_ws("\u0000", key, body), 256)
    return stream.withColumn("digest", digest).withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"])
