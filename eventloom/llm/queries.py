"""The queries of this package, each over the whole of its tables, and their SQL where SQL can express them."""

from __future__ import annotations

from eventloom.llm import decontam, langid, licenses, line_dedup, mixing, quality, secret_scan, simhash, suffix_dedup, warc
from eventloom.llm.common import table


def queries() -> dict:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
        "op2_simhash": lambda spark, d: simhash.digest(table(spark, d, "documents")),
        "op3_quality_rules": lambda spark, d: quality.quality_rules(table(spark, d, "documents")).select(*quality.DIGEST),
        "op4_warc": lambda spark, d: warc.digest(table(spark, d, "pages")),
        "op5_license_scan": lambda spark, d: licenses.digest(table(spark, d, "documents")),
        "op6_suffix_dedup": lambda spark, d: suffix_dedup.digest(table(spark, d, "documents")),
        "op7_decontaminate": lambda spark, d: decontam.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op8_secret_scan": lambda spark, d: secret_scan.digest(table(spark, d, "documents")),
        "op9_language_id": lambda spark, d: langid.digest(table(spark, d, "documents")),
        "op10_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.ORACLE, "op4_warc": warc.ORACLE}
