"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, lines, mixing, neighbours, packing, quality, sharding, simhash, substring, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": html.op1_html,
        "op2_packing": packing.op2_packing,
        "op3_sharding": sharding.op3_sharding,
        "op4_substring": substring.op4_substring,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_simhash": simhash.op6_simhash,
        "op7_warc": warc.op7_warc,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_lines": lines.op9_lines,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.OP3_SQL, "op5_quality_rules": quality.OP5_SQL, "op7_warc": warc.OP7_SQL}
