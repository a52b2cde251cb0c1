"""Text functions as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def trim_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's ``trim`` strips U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze_name(c: Column) -> Column:
    """Name regardless of case, white space, ``-`` and ``_``."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_\-]+", ""))


def hyphen_key(c: Column) -> Column:
    """Key in lower case, trimmed, with single hyphens for runs of separators."""
    return F.lower(F.regexp_replace(trim_ws(c), r"(?U)[\s_\-]+", "-"))
