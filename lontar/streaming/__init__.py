"""The rules as stateless transforms of streams. An addition: nothing here has a counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.locale import resolve_locale
from ..operators.lint import string_findings


def lint_stream(revisions: DataFrame) -> DataFrame:
    """Findings on the new text of each revision (key, locale, after, at) as it comes."""
    code = resolve_locale(F.col("locale"))
    return revisions.where(code.isNotNull()).select("key", "locale", "at", F.explode(string_findings(F.col("after"), code)).alias("f")).select("key", "locale", "at", "f.*")


def finding_counts(findings: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Findings by rule in windows of event time; those later than the watermark are left out."""
    return findings.withWatermark("at", late).groupBy(F.window("at", window), "rule").agg(F.count("*").alias("n"))
