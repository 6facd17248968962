"""Severity and confidence dictionaries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SEVERITY_NAMES = {
    "critical": "critical",
    "high": "high",
    "developing": "developing",
    "verified": "verified",
    "info": "info",
    "حرج": "critical",
    "عالي": "high",
    "قيد التطور": "developing",
    "موثق": "verified",
    "تم التحقق": "verified",
    "معلومات": "info",
}
CONFIDENCE_NAMES = {
    "verified": "verified",
    "unverified": "unverified",
    "developing": "developing",
    "موثق": "verified",
    "تم التحقق": "verified",
    "غير موثق": "unverified",
    "قيد التطور": "developing",
}
SEVERITY_RANK = {"critical": 5, "high": 4, "developing": 3, "verified": 2, "info": 1}
URGENT = ("critical", "high")
# -----------------------------------------------------------------------------


def _lookup(table: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def norm_severity(severity: Column) -> Column:
    """Case-insensitive, two languages, no trimming; anything else is ``info``."""
    return F.coalesce(F.try_element_at(_lookup(SEVERITY_NAMES), F.lower(severity)), F.lit("info"))


def norm_confidence(confidence: Column) -> Column:
    """Case-sensitive; anything else is ``developing``."""
    return F.coalesce(F.try_element_at(_lookup(CONFIDENCE_NAMES), confidence), F.lit("developing"))


def severity_rank(severity: Column) -> Column:
    return F.try_element_at(_lookup(SEVERITY_RANK), norm_severity(severity))
