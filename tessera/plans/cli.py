"""python -m tessera.plans.cli --golden FILE --corpus FOLDER [--mode M] [--top-k K] [--compare-bm25]: evaluates a golden set. Exit 0: its gates are passed."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate
from tessera.plans import service
from tessera.sources import readers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints a JSON object of rates for each mode that is evaluated; the exit code goes by the first."""
    p = argparse.ArgumentParser(description="Evaluates a golden set of questions against a folder of manuals.")
    p.add_argument("--golden", required=True)
    p.add_argument("--corpus", required=True)
    p.add_argument("--mode", choices=("hybrid", "bm25", "dense"))
    p.add_argument("--top-k", type=int)
    p.add_argument("--index-dir", help="where the chunks and vectors of the index are written as snapshots")
    p.add_argument("--compare-bm25", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera-eval").getOrCreate()
    given = {k: x for k, x in (("mode", a.mode), ("top_k", a.top_k)) if x is not None}
    settings = service.Settings.from_env(**given)
    idx = service.build(readers.manuals(spark, a.corpus), settings)
    if a.index_dir:
        service.index.save_snapshot(idx.chunks.join(idx.vectors, "chunk_ord", "left"), a.index_dir)
    golden, code = readers.golden(spark, a.golden), None
    # The comparison is cut to the same depth.
    for mode in dict.fromkeys([settings.mode, *["bm25"] * a.compare_bm25]):
        rates = evaluate.gate(service.run_eval(golden, idx, service.Settings(**{**settings.__dict__, "mode": mode}))[1])
        row = rates.select(F.lit(mode).alias("mode"), "*").first().asDict()
        print(json.dumps(row, default=float))
        code = (0 if row["passed"] else 1) if code is None else code
    return code


if __name__ == "__main__":
    raise SystemExit(main())
