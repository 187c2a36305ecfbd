"""Findings: one row for each problem, with a key that survives moved lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed order of severities.
SEVERITIES = ("P0", "P1", "P2", "Low")


def _col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def findings(rows: DataFrame, rule: Column | str, path: Column, message: Column | str, line: Column | None = None) -> DataFrame:
    """path, line, rule, message, key. The key leaves the line out: ``rule::path::message``."""
    rule, message = _col(rule), _col(message)
    return rows.select(
        path.alias("path"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        rule.alias("rule"),
        message.alias("message"),
        F.concat_ws("::", rule, path, message).alias("key"),
    )


def with_ordinals(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Repeats of a key, in ``order``, get `` #2``, `` #3`` and so on."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit(" #"), n.cast("string"))).otherwise(F.col(key)))


def check_severity(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Fails the job on a severity that nobody defined; ``severity_rank`` orders the known ones."""
    known = F.col(severity).isin(*SEVERITIES)
    checked = F.when(F.coalesce(known, F.lit(False)), F.col(severity)).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(F.col(severity), F.lit("null")))))
    return rows.withColumn(severity, checked.cast("string")).withColumn("severity_rank", F.array_position(F.lit(list(SEVERITIES)), F.col(severity)).cast("int"))


def suppress(found: DataFrame, suppressions: DataFrame, on: tuple[str, ...] = ("path", "line", "rule")) -> DataFrame:
    """Findings without those that a reasoned suppression names; one for another rule, or without a reason, does nothing."""
    valid = suppressions.where(F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0).select(*on).distinct()
    return found.join(valid, list(on), "left_anti")


#: Fixed form of an inline suppression: a comment ``audit-ok: <rule> <reason>``.
SUPPRESSION = r"#\s*audit-ok:\s*([A-Za-z0-9_]+)(?:\s+(.*\S))?"


def inline_suppressions(lines: DataFrame) -> DataFrame:
    """(path, line, text) -> (path, line, rule, reason) of the comments that suppress a rule on their line."""
    hit = lines.where(F.col("text").rlike(SUPPRESSION))
    return hit.select("path", "line", F.regexp_extract("text", SUPPRESSION, 1).alias("rule"), F.regexp_extract("text", SUPPRESSION, 2).alias("reason"))
