"""WARC archives in dictionary-compressed Zstandard, written and read through Spark's own file sources.

An archive is one file: a skippable frame (magic 0x184D2A5D) with the dictionary, then
each record as a frame of its own, so that any record can be read
alone. Between records stands an empty skippable frame, which decoders pass
over; it is the line separator of Spark's text writer, and so executors write
archives into any store that Spark can write to. The dictionary is built from the archive's
own records: of the task's first SAMPLE_BYTES, whatever their number.

Equal payloads of MIN_BYTES or more are stored once: the record with the smallest id is
a response, and each other one a revisit that refers to it.

Defined cases: a null payload is empty. Rows equal in id and payload are all
responses if theirs is the smallest id, else all revisits. A null id is larger than all others, and
of a payload that only null ids have all are responses. An empty table gives an archive without records. Extra columns
aren't read. A file cut short or with a wrong length or digest raises an error when read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import fresh_path, materialise, table

MIN_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 0, 4 << 20, 64 << 10, 6
ARCHIVE_BYTES = 64 << 20
_DICTIONARY_MAGIC, _EMPTY_FRAME = 0x184D2A5D, bytes.fromhex("502a4d1800000000")
_READ = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, sha1: str) -> bytes:
    """A WARC/1.1 record; a revisit has no block and names the payload that it repeats."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "Content-Type: text/html", "", ""]).encode() + block + b"\r\n\r\n"


def frames(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the records, None where they are too few or too alike to build one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL)
    except zstandard.ZstdError:
        return None


def _skippable(content: bytes) -> bytes:
    return _DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def parse(data: bytes) -> Iterator[tuple]:
    """(id, payload_bytes, digest, type, refers_to, url, payload) of an archive's records; lengths and digests are checked."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if len(data) < at + 8 + size:
                raise ValueError("archive is cut short")
            if magic == _DICTIONARY_MAGIC and size:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        frame = decompressor.decompressobj()
        raw = frame.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        upto = min(at + (1 << 16), len(data))
        while not frame.eof:
            if upto >= len(data):
                raise ValueError("archive is cut short")
            raw += frame.decompress(data[upto : upto + (1 << 20)])
            upto = min(upto + (1 << 20), len(data))
        at = upto - len(frame.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        payload = rest[:length]
        revisit = fields["WARC-Type"] == "revisit"
        sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if rest[length:] != b"\r\n\r\n" or not revisit and (digest(payload) != sha1 or length != int(fields["X-Payload-Length"])):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        number = lambda field: int(x) if (x := fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: E731, B023
        yield number("WARC-Record-ID"), int(fields["X-Payload-Length"]), sha1, fields["WARC-Type"], number("WARC-Refers-To"), fields["WARC-Target-URI"], None if revisit else payload


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes every row's record into archives under path, a folder."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # Only ids and hashes are dealt by payload; the least id is a partial aggregate, so a very common payload does no harm.
    keyed, _ = materialise(rows.select("id", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n")), "payloads")
    first = keyed.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = keyed.join(first, "sha1").where("first is not null and (id is null or id > first)").select(F.col("id").alias("again"), F.col("sha1").alias("same"), "first").distinct()
    joined = rows.withColumn("sha1", F.sha1("payload")).join(again, F.col("id").eqNullSafe(F.col("again")) & (F.col("sha1") == F.col("same")), "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, compressor = 0, None

        def out(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parts, type=pa.binary())], ["frame"])

        def start() -> tuple[zstandard.ZstdCompressor, list[bytes]]:
            trained = frames(held)
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained else zstandard.ZstdCompressor(level=LEVEL)
            return made, [_skippable(trained.as_bytes() if trained else b""), *map(made.compress, held)]

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                new = [record(p, u, h, r, digest(h)) for p, u, h, r in zip(*(batch.slice(low, 256).column(k).to_pylist() for k in range(4)), strict=True)]
                if compressor:
                    yield out([compressor.compress(x) for x in new])
                    continue
                held += new
                size += sum(map(len, new))
                if size >= SAMPLE_BYTES:
                    compressor, parts = start()
                    yield out(parts)
        if not compressor:
            yield out(start()[1])

    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    archives = max(1, -(-total // archive_bytes))
    done = joined.repartition(archives, F.xxhash64("id", "first")).mapInArrow(run, "frame binary")
    done.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _EMPTY_FRAME.decode("latin-1")).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """_READ of every record of the archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                size = 0
                for row in parse(data):
                    held.append((*row, name))
                    size += len(row[6] or b"")
                    if size > 8 << 20 or len(held) >= 10_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], [x.split()[0] for x in _READ.split(", ")])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the archives that it was written to."""
    path = fresh_path(spark, "archives")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
