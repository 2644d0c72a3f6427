"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.language_id import op3_language_id
from tessera.llm.line_dedup import op2_line_dedup
from tessera.llm.lm_scoring import op10_lm_scoring
from tessera.llm import mixing
from tessera.llm.mixing import op1_mixing
from tessera.llm.packing import op9_packing
from tessera.llm.quality_rules import op7_quality_rules
from tessera.llm.secret_scan import op5_secret_scan
from tessera.llm.simhash_groups import op8_simhash_groups
from tessera.llm.sketches import op6_sketches
from tessera.llm.warc import op4_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_language_id, op4_warc, op5_secret_scan, op6_sketches, op7_quality_rules, op8_simhash_groups, op9_packing, op10_lm_scoring)}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.oracle()}
