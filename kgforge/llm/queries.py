"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, html_extract, licenses, line_dedup, mixing, near_dup, quality, toxicity, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": lambda spark, d: html_extract.op1(table(spark, d, "pages")),
        "op2_line_dedup": lambda spark, d: line_dedup.op2(table(spark, d, "documents")),
        "op3_mixing": lambda spark, d: mixing.op3(table(spark, d, "documents")),
        "op4_near_dedup": lambda spark, d: near_dup.op4(table(spark, d, "documents")),
        "op5_toxicity": lambda spark, d: toxicity.op5(table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_license_scan": lambda spark, d: licenses.op6(table(spark, d, "documents")),
        "op7_quality": lambda spark, d: quality.op7(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_ann": lambda spark, d: ann.op8(table(spark, d, "embeddings")),
        "op9_decontamination": lambda spark, d: decontam.op9(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op10_warc": lambda spark, d: warc.op10(table(spark, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op6_license_scan": licenses.oracle(), "op10_warc": warc.ORACLE}
