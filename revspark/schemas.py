"""Relations of the engine and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]

FINDING = (
    "diff_id bigint, seq bigint, concern string, severity int, file string, line int, end_line int, message string, "
    "fix string, reasoning string, cwe string, confidence double, sast_source boolean"
)


def parse_severity(text: Column) -> Column:
    """0 (info) to 4 (critical) of a severity's name; unknown names are info."""
    name = F.lower(F.trim(text))
    found = F.lit(0)
    for rank, known in reversed(list(enumerate(SEVERITIES))):
        found = F.when(name == known, rank).otherwise(found)
    return found


def severity_name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), rank), F.lit("info"))
