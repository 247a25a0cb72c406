"""Text column expressions used in cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(name: Column) -> Column:
    """``east  khasi-hills`` becomes ``East Khasi Hills``; null stays null."""
    spaced = F.regexp_replace(F.translate(name, "-", " "), r"(?U)\s+", " ")
    return F.initcap(F.trim(spaced))


def canonical_pincode(code: Column) -> Column:
    """``560001.0`` and ``560001`` become the text ``560001``; other text raises."""
    return code.cast("double").cast("bigint").cast("string")
