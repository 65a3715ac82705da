"""Registry of this subpackage: name -> (Spark callable, verification SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op10_toxicity, op11_align, op12_chat, op13_runs, op1_pieces, op2_search, op3_urls, op4_minmax, op5_secrets, op6_lines, op7_mixing, op8_sharding, op9_fingerprints

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pieces": (op1_pieces.op1_pieces, None),
    "op2_search": (op2_search.op2_search, op2_search.ORACLE),
    "op3_url_filter": (op3_urls.op3_url_filter, op3_urls.oracle()),
    "op4_near_dedup": (op4_minmax.op4_near_dedup, op4_minmax.ORACLE),
    "op5_secret_scan": (op5_secrets.op5_secret_scan, None),
    "op6_line_dedup": (op6_lines.op6_line_dedup, op6_lines.ORACLE),
    "op7_mixing": (op7_mixing.op7_mixing, op7_mixing.ORACLE),
    "op8_sharding": (op8_sharding.op8_sharding, None),
    "op9_fingerprints": (op9_fingerprints.op9_fingerprints, None),
    "op10_toxicity": (op10_toxicity.op10_toxicity, None),
    "op11_align": (op11_align.op11_align, None),
    "op12_chat": (op12_chat.op12_chat, op12_chat.ORACLE),
    "op13_runs": (op13_runs.op13_runs, None),
}
