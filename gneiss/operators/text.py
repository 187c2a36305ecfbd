"""Queries over lines and free text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.findings import with_ordinals

#: Fixed pattern of debt markers and of what attributes one.
MARKER = r"(?i)#\s*(TODO|FIXME|XXX|HACK)\b"
ATTRIBUTED = r"\([^)]*\)|\d{4}-\d{2}-\d{2}|@\w+"


def lines(texts: DataFrame, path: Column, text: str = "text") -> DataFrame:
    """path, line (from 1), text: one row a line."""
    return texts.select(path.alias("path"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def line_key(text: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def keyed_lines(rows: DataFrame) -> DataFrame:
    """Adds key: the collapsed line, with an ordinal where a path repeats it."""
    out = rows.withColumn("key", F.concat_ws("::", "path", line_key(F.col("text"))))
    return with_ordinals(out, "key", ["line"])


def markers(rows: DataFrame) -> DataFrame:
    """Lines with a debt marker: path, line, marker (upper case), attributed, text."""
    hit = rows.where(F.col("text").rlike(MARKER))
    return hit.select("path", "line", F.upper(F.regexp_extract("text", MARKER, 1)).alias("marker"), F.col("text").rlike(ATTRIBUTED).alias("attributed"), F.trim("text").alias("text"))


def glyph_lines(rows: DataFrame) -> DataFrame:
    """Lines with a character beyond ASCII."""
    return rows.where(F.col("text").rlike(r"[^\x00-\x7F]"))


def mojibake(rows: DataFrame) -> DataFrame:
    """Lines in which a run of 3 or more characters beyond ASCII, written in cp1251, reads as different UTF-8 text: adds ``was`` and ``means``.

    The engine's ``encode`` doesn't know cp1251, so this one is an Arrow batch function.
    """
    import re

    run = re.compile(r"[^\x00-\x7f]{3,}")

    def found(text: str | None) -> tuple[str | None, str | None]:
        for m in run.finditer(text or ""):
            try:
                means = m[0].encode("cp1251").decode("utf-8")
            except UnicodeError:
                continue
            if means != m[0]:
                return m[0], means
        return None, None

    @F.pandas_udf("was string, means string")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([found(t) for t in b], columns=["was", "means"])

    suspects = glyph_lines(rows).withColumn("_m", look(F.col("text"))).where("_m.was is not null")
    return suspects.select(*rows.columns, F.col("_m.was").alias("was"), F.col("_m.means").alias("means"))


def cue_normal(text: Column) -> Column:
    """Lower case, hyphens between letters dropped, underscores as spaces, blanks collapsed."""
    low = F.regexp_replace(F.lower(text), r"(\p{L})-(?=\p{L})", "$1")
    return F.trim(F.regexp_replace(F.translate(low, "_", " "), r"\s+", " "))


def cue_agreement(records: DataFrame, id: str, declared: str, text: str, cues: Sequence[tuple[str, str]], anti: Sequence[str] = (), neutral: Sequence[str] = (), partitions: dict[str, str] | None = None) -> DataFrame:
    """Declared value against cue phrases (value, phrase) in free text: id, declared, cued, verdict, kind.

    A cue counts if some occurrence, bounded by words, lies outside every anti-cue. The declared value
    itself cued: agree. Nothing cued: uncheckable. Else the value of the longest, then earliest, then
    first-named cue decides: equal agrees; a declared value that is empty or neutral contradicts
    (unfilled_but_cued), one of another partition too (declared_opposes_text); otherwise agree.
    The cues are a parameter and stand in the plan; rows aren't shuffled.
    """
    from pyspark.sql.functions import array, array_compact, array_sort, struct, when

    t = F.col("_t")
    masked = t
    for phrase in sorted(anti, key=len, reverse=True):
        masked = F.regexp_replace(masked, rf"\b{phrase}\b", "\u0001" * len(phrase))
    m = F.col("_m")
    ordered = sorted(cues, key=lambda c: (-len(c[1]), c[0], c[1]))
    at = lambda p: F.regexp_instr(m, F.lit(rf"\b{p}\b"))
    hits = array_compact(array(*[when(m.rlike(rf"\b{p}\b"), struct(F.lit(-len(p)).alias("len"), at(p).alias("at"), F.lit(v).alias("value"))) for v, p in ordered]))
    rows = records.select(id, F.col(declared).cast("string").alias("declared"), cue_normal(F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("_m", masked)
    rows = rows.withColumn("_h", array_sort(hits)).withColumn("cued", F.get("_h", F.lit(0))["value"])
    own = F.exists("_h", lambda h: h["value"] == F.col("declared"))
    empty = F.col("declared").isNull() | (F.col("declared") == "") | F.col("declared").isin(*neutral)
    if partitions:
        part = F.create_map(*[F.lit(x) for kv in partitions.items() for x in kv])
        opposes = ~part[F.col("declared")].eqNullSafe(part[F.col("cued")])
    else:
        opposes = F.lit(True)
    contradicts = F.when(empty, F.lit("unfilled_but_cued")).when(opposes, F.lit("declared_opposes_text"))
    kind = F.when(F.coalesce(own, F.lit(False)) | F.col("cued").isNull() | F.col("cued").eqNullSafe(F.col("declared")), F.lit(None)).otherwise(contradicts)
    verdict = F.when(F.coalesce(own, F.lit(False)), F.lit("agree")).when(F.col("cued").isNull(), F.lit("uncheckable")).when(F.col("kind").isNotNull(), F.lit("contradict")).otherwise(F.lit("agree"))
    return rows.withColumn("kind", kind).withColumn("verdict", verdict).select(id, "declared", "cued", "verdict", "kind")
