"""Markdown manuals to sections, tables, images and chunks.

A document is parsed in one pass over its lines, since the title, the implicit
introduction, captions and the section tree depend on the lines before; documents
are the unit of parallelism (mapInPandas). Chunking is done in DataFrame operations on the
section rows. Nothing is collected.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.functions.text import code_anchors, slug

TABLES = "array<struct<table_no:int,caption:string,headers:array<string>,rows:array<array<string>>,raw:string,code_column:int,fault_rows:array<struct<code:string,row_idx:int,cells:array<struct<col:string,value:string>>>>>>"
SECTIONS = f"source_doc string, doc_ord long, doc_title string, unit_model string, section_ord int, parent_ord int, level int, title string, path array<string>, text string, warnings array<string>, safety boolean, tables {TABLES}, images array<struct<alt:string,src:string,caption:string>>"

_heading, _row, _rule, _image, _warning, _caption = (re.compile(p) for p in (v.HEADING, v.TABLE_ROW, v.TABLE_RULE, v.IMAGE, v.WARNING, v.CAPTION))
_boilerplate = [re.compile(p) for p in v.BOILERPLATE]
_column, _code = re.compile(v.CODE_COLUMN), re.compile(v.CELL_CODE)


def _hazard(title: str) -> bool:
    return any(w in title.lower() for w in v.SAFETY_HEADINGS)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def table_of(block: list[str], number: int, caption: str | None) -> dict:
    """A table's rows, and its fault rows where a header names a code; of a repeated code the last row counts."""
    headers, rows = _cells(block[0]), [_cells(x) for x in block[1:] if not _rule.match(x)]
    column = next((i for i, h in enumerate(headers) if _column.search(h)), None)
    faults: dict[str, tuple[int, list[dict]]] = {}
    if column is not None:
        for i, row in enumerate(rows):
            named = dict(zip(headers, [*row, *[""] * len(headers)], strict=False))
            for code in _code.findall(row[column] if column < len(row) else ""):
                faults[code.replace(" ", "")] = (i, [{"col": h, "value": x} for h, x in named.items()])
    return {"table_no": number, "caption": caption, "headers": headers, "rows": rows, "raw": "\n".join(block), "code_column": column, "fault_rows": [{"code": c, "row_idx": i, "cells": x} for c, (i, x) in faults.items()]}


def parse(source_doc: str, doc_ord: int, text: str | None, units: dict[str, str]) -> list[dict]:
    """SECTIONS of one document in reading order. units: pattern by model, in order of precedence."""
    joined = re.sub(r"(\w)-\n(\w)", r"\1\2", text or "")
    lines = deque((i, x.rstrip()) for i, x in enumerate(y for y in joined.splitlines() if not any(p.match(y) for p in _boilerplate)))
    raw = [x for _, x in lines]
    title, unit, sections, recent, tables = source_doc, None, [], deque(maxlen=3), 0
    open_: list[int] = []
    body: list[list[str]] = []

    def unit_in(x: str) -> str | None:
        return next((m for m, p in units.items() if re.search(p, x, re.IGNORECASE)), None)

    def begin(name: str, level: int, safe: bool) -> None:
        while open_ and sections[open_[-1]]["level"] >= level:
            open_.pop()
        sections.append({"level": level, "title": name, "parent_ord": open_[-1] if open_ else None, "warnings": [], "safety": safe, "tables": [], "images": []})
        body.append([])
        open_.append(len(sections) - 1)

    while lines:
        at, line = lines.popleft()
        if m := _heading.match(line):
            name = m[2].strip()
            unit = unit or unit_in(name)
            if len(m[1]) == 1 and not sections:
                title = name
            else:
                begin(name, len(m[1]), _hazard(name))
            continue
        if not sections:
            begin("(introduction)", 2, False)
        here = sections[-1]
        if _row.match(line):
            block = [line]
            while lines and _row.match(lines[0][1]) and len(block) < 10**6:
                block.append(lines.popleft()[1])
            if len(block) > 1:
                before = next((x for x in reversed(raw[:at]) if x.strip()), "")
                named = _caption.match(before)
                tables += 1
                here["tables"].append(table_of(block, tables, named[1].strip() if named else None))
                continue
        if m := _image.search(line):
            caption = next((x for x in reversed(recent) if len(x) > 12), None)
            here["images"].append({"alt": m[1], "src": m[2], "caption": caption})
            continue
        if m := _warning.match(line):
            kind = m[1].upper()
            here["warnings"].append(f"{kind}: {m[2].strip()}".rstrip())
            here["safety"] |= kind in ("DANGER", "WARNING")
        body[-1].append(line)
        if line.strip():
            recent.append(line.strip())
    for i, s in enumerate(sections):
        up = s["parent_ord"]
        s["safety"] |= _hazard(title) or (up is not None and sections[up]["safety"])
        s["path"] = [*(sections[up]["path"] if up is not None else [title]), s["title"]]
        s |= {"source_doc": source_doc, "doc_ord": doc_ord, "doc_title": title, "unit_model": unit, "section_ord": i, "text": "\n".join(body[i]).strip()}
    return sections


def sections(docs: DataFrame, units: dict[str, str]) -> DataFrame:
    """docs: (source_doc, doc_ord, text). SECTIONS of all of them; an empty document has none."""
    names = [f.split()[0] for f in "source_doc doc_ord doc_title unit_model section_ord parent_ord level title path text warnings safety tables images".split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [s for d, o, t in batch.itertuples(index=False) for s in parse(d, o, t, units)]
            frame = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
            yield frame

    return docs.select("source_doc", F.col("doc_ord").cast("long"), "text").mapInPandas(run, SECTIONS)


def _chunk_id(path: Column, kind: str, part: Column | None = None) -> Column:
    stem = slug(F.regexp_replace("source_doc", "\\.[^.]*$", ""))
    parts = F.concat(F.array(stem), F.transform(F.slice(path, 2, 1000), slug), F.array(F.lit(kind)))
    return F.array_join(parts if part is None else F.when(part > 0, F.concat(parts, F.array(F.concat(F.lit("p"), part)))).otherwise(parts), ":")


def paragraph_groups(text: Column, size: int = v.MAX_CHUNK_CHARS, separator: str = "\n\n") -> Column:
    """Paragraphs of a text longer than size in groups of about size code points; each group begins with the last paragraph of the one before."""
    paragraphs = F.filter(F.split(text, separator), lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")) != "")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, p: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["size"] + F.length(p) > size)
        last = F.slice(acc["open"], -1, 1)
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.concat(last, F.array(p)).alias("open"), (F.length(F.element_at(acc["open"], -1)) + F.length(p)).alias("size"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(p)).alias("open"), (acc["size"] + F.length(p)).alias("size"))
        )

    groups = F.aggregate(paragraphs, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(groups, lambda g: F.array_join(g, separator)))


def _steps(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of procedure sections: (key, number, text) of each step, and the lines before the first."""
    lines = body.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("number", F.regexp_extract("line", v.STEP, 1)).withColumn("own", F.when(F.col("number") != "", F.trim(F.regexp_extract("line", v.STEP, 2))).otherwise(F.trim("line")))
    lines = lines.withColumn("step", F.sum((F.col("number") != "").cast("int")).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    parts = lines.where("step > 0").groupBy("key", "step").agg(F.max(F.col("number").try_cast("long")).alias("number"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]), lambda x: x != ""), " ").alias("text"))
    intro = lines.where("step = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parts, intro.where("n >= 2").select("key", F.regexp_replace("text", "^\\s+|\\s+\\z", "").alias("text")).where("text <> ''")


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks of SECTIONS: (chunk_ord struct that orders them, id, text, breadcrumb, source_doc, unit_model, chunk_type, safety, code_anchors, fault_rows, caption, image_ref)."""
    none = F.lit(None).cast("string")
    no_rows = F.array().cast("array<struct<code:string,row_idx:int,cells:array<struct<col:string,value:string>>>>")
    base = parsed.withColumn("key", F.struct("doc_ord", "section_ord"))
    body = base.where(F.length("text") >= v.MIN_BODY_CHARS)
    is_steps = F.regexp_count("text", F.lit("(?m)" + v.STEP)) >= v.MIN_STEPS
    parts, intro = _steps(body.where(is_steps))
    keep = base.select("key", "source_doc", "unit_model", "path", F.col("safety").alias("section_safety"))

    def finish(rows: DataFrame, kind_ord: int, seq: Column, kind: str, text: Column, chunk_id: Column, anchors_of: Column, path: Column, fault_rows: Column = no_rows, caption: Column = none, image: Column = none) -> DataFrame:
        return rows.select(
            F.struct(F.col("key.doc_ord").alias("doc_ord"), F.col("key.section_ord").alias("section_ord"), F.lit(kind_ord).alias("kind_ord"), seq.cast("int").alias("seq")).alias("chunk_ord"),
            chunk_id.alias("id"), text.alias("text"), path.alias("breadcrumb"), "source_doc", "unit_model", F.lit(kind).alias("chunk_type"),
            (F.col("section_safety") | anchors_of.rlike(v.CHUNK_WARNING)).alias("safety"),
            (F.when(F.size(fault_rows) > 0, F.array_sort(fault_rows["code"])).otherwise(code_anchors(anchors_of))).alias("code_anchors"),
            fault_rows.alias("fault_rows"), caption.alias("caption"), image.alias("image_ref"),
        )

    headed = lambda path, text: F.concat(F.lit("["), F.array_join(path, " > "), F.lit("]\n\n"), text)
    long = body.where(~is_steps).select("key", F.posexplode(paragraph_groups(F.col("text"))).alias("part", "piece")).withColumn("piece", F.regexp_replace("piece", "^\\s+|\\s+\\z", "")).join(keep, "key")
    plain = finish(long, 0, F.col("part"), "section", headed(F.col("path"), F.col("piece")), _chunk_id(F.col("path"), "sec", F.col("part")), F.col("piece"), F.col("path"))
    intros = intro.join(keep, "key")
    first = finish(intros, 0, F.lit(0), "section", headed(F.col("path"), F.col("text")), _chunk_id(F.col("path"), "sec"), F.col("text"), F.col("path"))
    group = F.floor((F.col("step") - 1) / v.STEP_GROUP)
    grouped = parts.groupBy("key", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("step", "number", "text"))).alias("s"))
    grouped = grouped.withColumn("body", F.array_join(F.transform("s", lambda x: F.concat(x["number"], F.lit(". "), x["text"])), "\n")).join(keep, "key")
    grouped = grouped.withColumn("path", F.concat("path", F.array(F.concat(F.lit("Step "), F.element_at("s", 1)["number"], F.lit("-"), F.element_at("s", -1)["number"]))))
    steps = finish(grouped, 0, F.col("g") + 1, "steps", headed(F.col("path"), F.col("body")), _chunk_id(F.col("path"), "steps"), F.col("body"), F.col("path"))
    tabled = base.select("key", "source_doc", "unit_model", "path", F.col("safety").alias("section_safety"), F.explode("tables").alias("t")).withColumn("raw", F.concat(F.lit("[Table]"), F.coalesce(F.concat(F.lit(" "), "t.caption"), F.lit("")), F.lit("\n\n"), F.col("t.raw")))
    tables = finish(tabled, 1, F.col("t.table_no"), "table", F.col("raw"), _chunk_id(F.col("path"), "table"), F.col("raw"), F.col("path"), F.col("t.fault_rows"), F.col("t.caption"))
    pictured = base.select("key", "source_doc", "unit_model", "path", F.col("safety").alias("section_safety"), F.posexplode("images").alias("n", "i"))
    shown = F.coalesce(F.when(F.col("i.caption") != "", F.col("i.caption")), F.when(F.col("i.alt") != "", F.col("i.alt")), F.lit("Figure (caption unavailable)"))
    figure = F.concat(F.lit("[Figure] "), shown, F.lit(" (asset: "), F.col("i.src"), F.lit(")"))
    images = finish(pictured, 2, F.col("n"), "image", figure, _chunk_id(F.col("path"), "image"), figure, F.col("path"), caption=shown, image=F.col("i.src"))
    out = plain
    for other in (first, steps, tables, images):
        out = out.unionByName(other)
    return out
