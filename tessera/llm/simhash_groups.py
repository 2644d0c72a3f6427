"""Near-duplicate groups of SimHash fingerprints by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits, and each segment is
replaced by its count of ones, written in unary (the bits of the segment
sorted). The Hamming distance of two such words is the Manhattan distance of
the count vectors, which is never above the Hamming distance of the
fingerprints. The segments are dealt to radius + spare groups; two vectors
within the radius agree on spare groups at least, so they share a cell of
width one in one of the grids that a choice of spare groups spans. Inside a cell the
Manhattan bound comes first, the exact distance second.

Defined cases: a null or blank text has fingerprint 0, and such texts link like
any others. Equal fingerprints are one node, however many rows hold them. Rows
with equal ids stay separate rows. A null id is no component's name: a group of null ids alone has a null component. An empty table gives
an empty result. Only the named id and text columns are read, so other columns can't clash; the stage's own column has a name that the table hasn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels, line_dedup
from tessera.llm.blocks import SMALL_ROWS, links_in_blocks
from tessera.llm.components import components
from tessera.llm.hamming import cell_links
from tessera.llm.line_dedup import Bloom
from tessera.llm.shared import fresh_names, materialise, small, table

RADIUS, SPARE, SHINGLE = 4, 2, 4
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_BANDS, STAGE_ORDERS = 5, 0.8, 16, 4
#: At a similarity of 0.8 about 9.7 of 64 bits differ, with a deviation of 2.9: so many are five deviations off.
STAGE_WIDE = 24
_EVEN = 0x5555555555555555


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """SimHash of each text's word shingles, as unsigned 64-bit values."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for block in kernels.blocks(texts):
        data = kernels.LOWER[block.data]
        starts, ends = kernels.words(data, block.offsets)
        if not len(starts):
            continue
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[ends] = True
        inside[: len(data)] |= ~kernels._BLANKS[data]
        place = np.cumsum(inside) - inside
        joined = np.append(data, np.uint8(32))
        joined[ends[kernels._BLANKS[joined[ends]]]] = 32
        # A word that ends where the next document begins without a blank has no byte of its own for the separator; slices never cross documents.
        joined = joined[inside].tobytes()
        doc = kernels.owners(starts, block.offsets)
        docs, first, count = np.unique(doc, return_index=True, return_counts=True)
        n = np.maximum(count - shingle + 1, 1)
        each = np.repeat(np.arange(len(docs)), n)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        low = first[each] + np.arange(len(each)) - begin[each]
        high = low + np.minimum(count, shingle)[each] - 1
        s, e = place[starts[low]].tolist(), place[ends[high] - 1].tolist()
        h = np.fromiter((digest(joined[i : j + 1], seed) for i, j in zip(s, e, strict=True)), dtype=np.uint64, count=len(s))
        out[block.first + docs] = kernels.majority(h, n)
    return out


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; the bits of fp are the fingerprint's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def embed(values: np.ndarray) -> np.ndarray:
    """Per-segment counts of ones in unary: the bits of each two-bit segment, sorted."""
    m, one = np.uint64(_EVEN), np.uint64(1)
    return ((values | (values >> one)) & m) | (((values & (values >> one)) & m) << one)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(embed(x) ^ embed(y))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_cells(fp: Column, radius: int = RADIUS, spare: int = SPARE) -> Column:
    """The array of grid cells of a fingerprint, one for each choice of spare groups of segments."""
    one = F.shiftrightunsigned(fp, 1)
    even = F.lit(_EVEN)
    counts = fp.bitwiseOR(one).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(one).bitwiseAND(even), 1))
    groups = radius + spare
    masks = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return F.array(*[F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(_signed(sum(masks[g] for g in chosen))))) for k, chosen in enumerate(combinations(range(groups), spare))])


def links(nodes: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """nodes: distinct (fp long). Edges (a, b) that span each connected group of fingerprints within the radius."""
    rows = nodes.select(F.explode(grid_cells(F.col("fp"), radius, spare)).alias("cell"), F.col("fp").alias("id"), F.col("fp").alias("value"))
    return cell_links(rows, radius, manhattan)


def near_groups(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE, edges: DataFrame | None = None, by: Column | None = None) -> DataFrame:
    """prints: (id, fp, ...), read twice and so best materialised. Its columns and component: the least id (or value of by) reachable over links, or over edges (a, b) of fp where given."""
    nodes = prints.groupBy("fp").agg(F.min(F.col("id") if by is None else by).alias("least"))
    roots = components(links(prints.select("fp").distinct(), radius, spare) if edges is None else edges)
    linked = roots.join(nodes, roots.node == nodes.fp).select("node", "root", "least")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(lowest, "root").select("node", "component")
    by_print = nodes.join(linked, nodes.fp == linked.node, "left").select(nodes.fp, F.coalesce("component", "least").alias("component"))
    return prints.join(by_print, "fp").select(*prints.columns, "component")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every document."""
    prints, _ = materialise(with_fingerprints(table(spark, sf_dir, "documents")), "prints")
    return near_groups(prints).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _shingled(texts: pa.Array):
    """Of each block: its texts' keys (0: no words), the texts that have words, all shingles of STAGE_SHINGLE words (fewer words: one shingle), and each such text's first and last."""
    for block in kernels.blocks(texts):
        data = kernels.LOWER[block.data]
        starts, ends = kernels.words(data, block.offsets)
        keys = np.zeros(block.last - block.first, dtype=np.uint64)
        docs, first, count = np.unique(kernels.owners(starts, block.offsets), return_index=True, return_counts=True)
        words = kernels.Hasher(data)(starts, ends)
        keys[docs] = line_dedup._keys(words, first, first + count)
        n = np.maximum(count - STAGE_SHINGLE + 1, 1)
        begin = np.cumsum(n) - n
        low = np.repeat(first - begin, n) + np.arange(n.sum())
        yield keys, docs, line_dedup._keys(words, low, low + np.repeat(np.minimum(count, STAGE_SHINGLE), n)), begin, begin + n


def _texts(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("row"), "text")


def shingle_prints(df: DataFrame) -> DataFrame:
    """(id, row, fp, print, cells) of each row: a key of its id and text, the key of its words in order, the SimHash of its distinct shingles, and its cells of least shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, docs, shingles, first, last in _shingled(batch.column(2)):
                cells = line_dedup.word_cells(line_dedup.word_minima(shingles, np.full(len(shingles), 9), first, last, STAGE_BANDS * STAGE_ORDERS), STAGE_ORDERS) if len(docs) else np.zeros((0, STAGE_BANDS), dtype=np.uint64)
                n = np.zeros(len(keys), dtype=np.int32)
                n[docs] = STAGE_BANDS
                prints = np.zeros(len(keys), dtype=np.uint64)
                prints[docs] = line_dedup.simhash(shingles, first, last)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(cells.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(keys)), batch.column(1).slice(at, len(keys)), pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64)), lists], ["id", "row", "fp", "print", "cells"])
                at += len(keys)

    return _texts(df).mapInArrow(run, "id long, row long, fp long, print long, cells array<long>")


def shingle_sets(df: DataFrame, wanted: Bloom) -> DataFrame:
    """(key, shingles) of each wanted row (and of few others) with words: its distinct shingles, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column(1).to_numpy().view(np.uint64))))
            for keys, docs, shingles, first, last in _shingled(batch.column(2)):
                sets = [np.unique(shingles[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[docs].view(np.int64)), pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64()))], ["key", "shingles"])

    return _texts(df).mapInArrow(run, "key long, shingles array<long>")


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that span the groups of sets linked by a Jaccard similarity of so much or more, found breadth first."""
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rest, a, b = np.ones(len(sets), dtype=bool), [], []
    for top in range(len(sets)):
        if not rest[top]:
            continue
        rest[top] = False
        frontier = [top]
        while frontier and rest.any():
            i = frontier.pop()
            own = np.zeros(len(values), dtype=np.int64)
            own[flat[begin[i] : begin[i] + size[i]]] = 1
            both = np.add.reduceat(own[flat], begin)
            near = np.flatnonzero(rest & (both >= similarity * (size + size[i] - both) - 1e-9))
            rest[near] = False
            a += [i] * len(near)
            b += near.tolist()
            frontier += near.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def shingle_candidates(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE, wide: int = STAGE_WIDE) -> DataFrame:
    """prints: (fp, print, cells), materialised. Edges (a, b) of fp whose components hold all candidates: SimHash values within the radius, by the
    grids of segment popcounts, and those within wide among texts that share a cell of least shingles. Texts without words have no candidates.
    """
    nodes = prints.where("size(cells) > 0").select("fp", "print", "cells").dropDuplicates(["fp"])
    grids = nodes.select(F.explode(grid_cells(F.col("print"), radius, spare)).alias("cell"), F.col("fp").alias("id"), F.col("print").alias("value"))
    least = nodes.select(F.explode("cells").alias("cell"), F.col("fp").alias("id"), F.col("print").alias("value"))
    return cell_links(grids, radius, manhattan).union(cell_links(least, wide, manhattan))


def shingle_links(docs: DataFrame, prints: DataFrame, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """prints: shingle_prints of docs, materialised. Edges (a, b) of keys that span the groups of verified candidates."""
    whole, _ = materialise(components(shingle_candidates(prints)).select(F.col("node").alias("key"), F.col("root").alias("whole")), "wholes")
    rows, _ = materialise(prints.join(small(whole, SMALL_ROWS), prints.fp == whole.key).groupBy("fp").agg(F.min("row").alias("row")).select("row"), "wanted")
    sets, _ = materialise(shingle_sets(docs, Bloom(rows, "row", rows.count())).join(small(whole, SMALL_ROWS), "key").dropDuplicates(["key"]).select("whole", "key", "shingles"), "sets")

    def link(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return alike([np.array(s, dtype=np.int64) for s in part.column("shingles").to_pylist()], similarity)

    return links_in_blocks(sets, ["shingles"], link, 512)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest doc_id, null ids last, then the least key of its id and text; rows equal to it stay too.

    Unlike op8's, groups are linked by shingles of STAGE_SHINGLE words at a Jaccard similarity of STAGE_SIMILARITY or more.
    Candidates are those whose SimHash of shingles lies within RADIUS bits, all found by the grids of segment popcounts, and of the texts that share the
    least shingles by STAGE_ORDERS orders in one of STAGE_BANDS bands (at 0.8 all but about 1 in 4,000 do) those within STAGE_WIDE bits.
    """
    prints, _ = materialise(shingle_prints(docs), "prints")
    first = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    (own,) = fresh_names(docs, 1)
    gone = near_groups(prints.select("id", "row", "fp"), edges=shingle_links(docs, prints), by=first).where(first != F.col("component"))
    gone, _ = materialise(gone.select(F.col("row").alias(own)).distinct(), "gone")
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.withColumn(own, key).join(small(gone, SMALL_ROWS), own, "left_anti").select(docs.columns)
