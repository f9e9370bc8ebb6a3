"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontamination, fim, fingerprint, jaccard, language, licenses, packing, pii, sharding, substrings, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_urls": urls.op2_urls,
        "op3_packing": packing.op3_packing,
        "op4_language": language.op4_language,
        "op5_licenses": licenses.op5_licenses,
        "op6_substrings": substrings.op6_substrings,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_pii": pii.op9_pii,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_fim": fim.op11_fim,
        "op12_sharding": sharding.op12_sharding,
        "op13_audit": audit.op13_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op2_urls": urls.ORACLE, "op6_substrings": substrings.ORACLE, "op8_jaccard": jaccard.ORACLE, "op10_decontamination": decontamination.ORACLE, "op11_fim": fim.ORACLE, "op13_audit": audit.ORACLE}
