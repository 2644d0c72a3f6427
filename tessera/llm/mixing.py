"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (here domain, language, source) has an integer weight at every node.
The budget of a node is dealt to its children by weight, but none gets more than its
subtree can give in MAX_EPOCHS readings; what one falls short goes to its siblings by
weight, and only what all siblings can't take stays with the ancestors' other
children. Since each child's bound is that of its whole subtree, dealing from the
root down does both. Budgets are exact integers that add up.

A leaf reads its documents in epochs, each in an order of its own from the seed: whole
epochs first, then the token-prefix of the next one. A running sum over a leaf's
whole order would put a large leaf into one task. So a leaf's order is cut into buckets by the order's leading
bits, about BUCKET documents each; bucket sums tell the one bucket in which the prefix
ends, and only that bucket is sorted.

Defined cases: null levels are the value ''. A null or blank text has 0 tokens and is taken 0 of. A
weight of 0 takes nothing. Equal rows follow each other in arbitrary
order, which doesn't change the set of results. Null ids stand for '' in the order. An empty table gives an empty result. The query reads
four columns only; the stage passes all others through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import fresh_names, materialise, small, table

SEED, PERCENT, MAX_EPOCHS, BUCKET = 17, 60, 2, 1000
WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")
#: (path, weight); '*' stands for any value. The first that fits holds; 1 where none does.
WEIGHTS = [(("d0",), 5), (("d1",), 3), (("d2",), 2), (("*", "en"), 6), (("d1", "es"), 3), (("*", "fr"), 2), (("*", "de"), 2), (("*", "*", "src0"), 2)]
_D = "decimal(38,0)"


def weight_of(levels: Sequence[str], weights: list) -> Column:
    """The weight of the node at these levels."""
    out = F.lit(1)
    for path, weight in reversed([x for x in weights if len(x[0]) == len(levels)]):
        fits = F.lit(True)
        for level, value in zip(levels, path, strict=True):
            fits = fits & (F.col(level) == value) if value != "*" else fits
        out = F.when(fits, F.lit(weight)).otherwise(out)
    return out.cast("bigint")


def _deal(nodes: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """nodes: parent's levels, own level, cap, weight, given (the parent's budget). Adds budget."""
    by_ratio = W.partitionBy(*parent).orderBy(F.expr("cap / weight"), own)
    all_ = W.partitionBy(*parent)
    rows = nodes.where("weight > 0 and cap > 0")
    rows = rows.withColumn("c_sum", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0))).withColumn("w_rest", F.sum("weight").over(all_) - F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("short", F.expr(f"cast(c_sum as {_D}) * weight + cast(cap as {_D}) * w_rest <= cast(given as {_D}) * weight"))
    rows = rows.withColumn("left", F.col("given") - F.sum(F.when(F.col("short"), F.col("cap")).otherwise(0)).over(all_)).withColumn("w_open", F.sum(F.when(F.col("short"), 0).otherwise(F.col("weight"))).over(all_))
    rows = rows.withColumn("upto", F.sum(F.when(F.col("short"), 0).otherwise(F.col("weight"))).over(W.partitionBy(*parent).orderBy(own).rowsBetween(W.unboundedPreceding, 0)))
    dealt = f"cast((cast(left as {_D}) * upto) div w_open as bigint) - cast((cast(left as {_D}) * (upto - weight)) div w_open as bigint)"
    return rows.withColumn("budget", F.expr(f"case when short then cap else {dealt} end"))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: list, budget: int | None = None, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: the levels, tokens, docs. With budget; without one it is that percentage of all tokens."""
    caps: DataFrame = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("weight", weight_of(levels, weights)).withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    by_depth = {len(levels): caps.select(*levels, "cap", "weight")}
    for depth in range(len(levels) - 1, 0, -1):
        own = levels[:depth]
        node = by_depth[depth + 1].groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(own, weights))
        by_depth[depth] = node.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    top = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    wanted = F.lit(budget).cast("bigint") if budget is not None else F.expr(f"all * {percent} div 100")
    total = int(top.select(wanted).first()[0])
    most = int(by_depth[1].agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0])
    given = by_depth[1].withColumn("given", F.lit(min(total, most)).cast("bigint"))
    for depth in range(1, len(levels) + 1):
        dealt = _deal(given, levels[: depth - 1], levels[depth - 1]).select(*levels[:depth], "budget")
        if depth < len(levels):
            given = by_depth[depth + 1].join(dealt.withColumnRenamed("budget", "given"), list(levels[:depth]))
    return leaves.join(dealt, list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("bigint")))


def _place(seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col("_full"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))


def _bucket() -> Column:
    """The leading _bits bits of a document's place in the order."""
    return F.expr("shiftright(cast(conv(substring(_at, 1, 6), 16, 10) as bigint), 24 - _bits)")


def _rows(df: DataFrame, levels: dict[str, Column], id_col: str, tokens: Column | None, keep: bool) -> DataFrame:
    """Each row's levels, id and tokens under the names of this module, and where asked the table's columns by their places, so that no name can clash."""
    tokens = F.regexp_count("text", F.lit(WORD)) if tokens is None else tokens
    own = [df[c].alias(f"c{i}") for i, c in enumerate(df.columns)] if keep else []
    return df.select(*own, *[F.coalesce(c.cast("string"), F.lit("")).alias(f"_l{i}") for i, c in enumerate(levels.values())], df[id_col].alias("_id"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("_n"))


def _with_leaf(rows: DataFrame, plan: DataFrame, levels: dict[str, Column], seed: int) -> DataFrame:
    """_rows with their leaf's figures and their places in the order."""
    figures = plan.select(*[F.col(n).alias(f"_l{i}") for i, n in enumerate(levels)], *[F.col(c) for c in plan.columns if c.startswith("_")])
    return rows.join(small(figures, 100_000), [f"_l{i}" for i in range(len(levels))]).withColumn("_at", _place(seed))


def plan_mix(df: DataFrame, levels: dict[str, Column], weights: list, id_col: str = "doc_id", tokens: Column | None = None, seed: int = SEED, bucket: int = BUCKET, **budget) -> DataFrame:
    """One row for each leaf: whole epochs, the tokens of the prefix, and the bucket in which it ends. Materialised."""
    names, rows = list(levels), _rows(df, levels, id_col, tokens, False)
    cols = [F.col(f"_l{i}").alias(n) for i, n in enumerate(names)]
    leaves, _ = materialise(rows.groupBy(*cols).agg(F.sum("_n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    dealt = leaf_budgets(leaves, names, weights, **budget)
    plan = dealt.select(*names, F.coalesce(F.expr("try_divide(budget - budget % greatest(tokens, 1), tokens)").cast("int"), F.lit(0)).alias("_full"), F.expr("budget % greatest(tokens, 1)").alias("_rest"), F.expr(f"cast(least(24, ceil(log2(1 + docs / {bucket}.0D))) as int)").alias("_bits"))
    plan, _ = materialise(plan, "budgets")
    sums = _with_leaf(rows, plan, levels, seed).where("_rest > 0").groupBy(*[f"_l{i}" for i in range(len(names))], "_rest", _bucket().alias("_b")).agg(F.sum("_n").alias("s"))
    upto = sums.withColumn("e", F.sum("s").over(W.partitionBy(*[f"_l{i}" for i in range(len(names))]).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
    last = upto.where("e >= _rest and e - s < _rest").groupBy(*[F.col(f"_l{i}").alias(n) for i, n in enumerate(names)]).agg(F.min("_b").alias("_last"), F.min(F.col("e") - F.col("s")).alias("_before"))
    return materialise(plan.join(last, names, "left").withColumn("_last", F.coalesce("_last", F.lit(-1).cast("bigint"))), "plan")[0]


def apply_mix(df: DataFrame, plan: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", tokens: Column | None = None, seed: int = SEED, into: Sequence[str] = ("_n", "_full", "_taken")) -> DataFrame:
    """df with three more columns, named by into: tokens, whole epochs, and tokens of the prefix that fall to the row. A column of df with such a name gives way."""
    keys = [f"_l{i}" for i in range(len(levels))]
    rows = _with_leaf(_rows(df, levels, id_col, tokens, True), plan, levels, seed).withColumn("_b", _bucket())
    out = [*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c not in into], *[F.col(c).alias(n) for c, n in zip(("_n", "_full", "_taken"), into, strict=True)]]
    clear = rows.where("_b <> _last").withColumn("_taken", F.expr("case when _b < _last then _n else 0L end"))
    running = F.sum("_n").over(W.partitionBy(*keys).orderBy("_at", "_id", "_n").rowsBetween(W.unboundedPreceding, 0))
    edge = rows.where("_b = _last").withColumn("_end", F.col("_before") + running).withColumn("_taken", F.expr("greatest(0L, least(_n, _rest - (_end - _n)))"))
    return clear.select(out).unionByName(edge.select(out))


def document_levels() -> dict[str, Column]:
    """Domain, language and source of documents; the domain is the source's number modulo 3."""
    return {"domain": F.concat(F.lit("d"), (F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int") % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, full_epochs, last_tokens (of the prefix epoch) and all tokens taken, of every document."""
    levels = document_levels()
    docs = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in levels.items()], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))
    docs, _ = materialise(docs, "tokens")
    own = {n: F.col(n) for n in levels}
    plan = plan_mix(docs, own, WEIGHTS, tokens=F.col("n_tokens"))
    done = apply_mix(docs, plan, own, tokens=F.col("n_tokens"))
    return done.select("doc_id", "n_tokens", F.col("_full").cast("long").alias("full_epochs"), F.col("_taken").alias("last_tokens"), (F.col("_full") * F.col("_n") + F.col("_taken")).alias("taken"))


def _weight_sql(levels: Sequence[str]) -> str:
    whens = "".join(f" WHEN {' AND '.join(f"{level} = '{v}'" for level, v in zip(levels, path, strict=True) if v != '*') or 'true'} THEN {w}" for path, w in WEIGHTS if len(path) == len(levels))
    return f"CASE{whens} ELSE 1 END" if whens else "1"


def oracle() -> str:
    """The same rows by windows over whole leaves."""
    parts = [
        "docs AS (SELECT doc_id, coalesce('d' || (nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '')::INT % 3), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)",
        f"n3 AS (SELECT *, CASE WHEN weight > 0 THEN tokens * {MAX_EPOCHS} ELSE 0 END AS cap FROM (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, {_weight_sql(LEVELS)} AS weight FROM docs GROUP BY ALL))",
    ]
    for depth in (2, 1):
        own = ", ".join(LEVELS[:depth])
        parts.append(f"n{depth} AS (SELECT {own}, weight, CASE WHEN weight > 0 THEN cap ELSE 0 END AS cap FROM (SELECT {own}, sum(cap)::HUGEINT AS cap, {_weight_sql(LEVELS[:depth])} AS weight FROM n{depth + 1} GROUP BY {own}))")
    parts.append(f"g1 AS (SELECT *, least((SELECT sum(tokens) * {PERCENT} // 100 FROM n3), (SELECT sum(cap) FROM n1))::HUGEINT AS given FROM n1)")
    for depth in (1, 2, 3):
        over = f"PARTITION BY {', '.join(LEVELS[: depth - 1])}" if depth > 1 else ""
        own = LEVELS[depth - 1]
        if depth > 1:
            parts.append(f"g{depth} AS (SELECT n{depth}.*, b{depth - 1}.budget AS given FROM n{depth} JOIN b{depth - 1} USING ({', '.join(LEVELS[: depth - 1])}))")
        rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        ratio = f"({over} ORDER BY cap::DOUBLE / weight, {own} {rows})"
        parts += [
            f"s{depth} AS (SELECT *, sum(cap) OVER {ratio} * weight + cap * (sum(weight) OVER ({over}) - sum(weight) OVER {ratio}) <= given * weight AS short FROM g{depth} WHERE weight > 0 AND cap > 0)",
            f"o{depth} AS (SELECT *, given - sum(CASE WHEN short THEN cap ELSE 0 END) OVER ({over}) AS rest, sum(CASE WHEN short THEN 0 ELSE weight END) OVER ({over}) AS open, sum(CASE WHEN short THEN 0 ELSE weight END) OVER ({over} ORDER BY {own} {rows}) AS upto FROM s{depth})",
            f"b{depth} AS (SELECT {', '.join(LEVELS[:depth])}, (CASE WHEN short THEN cap ELSE rest * upto // open - rest * (upto - weight) // open END)::HUGEINT AS budget FROM o{depth})",
        ]
    parts += [
        "plan AS (SELECT n3.domain, n3.lang, n3.source, coalesce(budget, 0) // greatest(tokens, 1) AS whole, coalesce(budget, 0) % greatest(tokens, 1) AS rest FROM n3 LEFT JOIN b3 USING (domain, lang, source))",
        f"o AS (SELECT doc_id, n_tokens, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}-' || whole || '-' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM docs JOIN plan USING (domain, lang, source))",
    ]
    last = "greatest(0, least(n_tokens, rest - (upto - n_tokens)))"
    return f"WITH {', '.join(parts)} SELECT doc_id, n_tokens, whole::BIGINT AS full_epochs, ({last})::BIGINT AS last_tokens, (whole * n_tokens + {last})::BIGINT AS taken FROM o"


STAGE_PERCENT = 90


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to STAGE_PERCENT of all tokens, each at most once; the one in which a leaf's prefix ends is cut there and n_chars counted anew."""
    levels = document_levels()
    plan = plan_mix(docs, levels, WEIGHTS, percent=STAGE_PERCENT, max_epochs=1)
    n, full, rest, k = fresh_names(docs, 4)
    taken = apply_mix(docs, plan, levels, into=(n, full, rest)).withColumn(k, (F.col(full) * F.col(n) + F.col(rest)).cast("int")).where(F.col(k) > 0)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), F.col(k)), "")
    cut = taken.withColumn("text", F.when(F.col(k) < F.col(n), cut).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col(k) < F.col(n), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)
