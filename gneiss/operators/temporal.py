"""Queries over ordered histories. Each window is partitioned by the history's own key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shrinks(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, waivers: DataFrame | None = None, waived_on: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is below the one before in the same history, with ``previous``; waived rows fall out."""
    prev = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    out = rows.withColumn("previous", prev).where(F.col(value) < F.col("previous"))
    return out if waivers is None else out.join(waivers.select(*waived_on), list(waived_on), "left_anti")


def row_count(blob: Column) -> Column:
    """Rows of a text: line feeds, and one more if it is not empty and doesn't end with one."""
    return F.length(blob) - F.length(F.translate(blob, "\n", "")) + F.when((F.length(blob) > 0) & ~F.endswith(blob, F.lit("\n")), 1).otherwise(0)


#: Fixed conclusions of runs.
IGNORED, GREEN = ("cancelled", "skipped", "stale"), ("success", "neutral")


def red_streaks(runs: DataFrame, by: Sequence[str], id: str = "id", at: str = "created_at", conclusion: str = "conclusion") -> DataFrame:
    """Histories whose newest completed run isn't green: by, red_since, n_red, lower_bound.

    Ignored conclusions and repeated ids count once or not at all. red_since is the oldest run of the
    leading streak; without any green run it is only a lower bound.
    """
    done = runs.where(F.col(conclusion).isNotNull() & ~F.col(conclusion).isin(*IGNORED))
    done = done.groupBy(*by, id).agg(F.max(F.struct(at, conclusion)).alias("r")).select(*by, id, f"r.{at}", f"r.{conclusion}")
    green = F.col(conclusion).isin(*GREEN)
    last = done.groupBy(*by).agg(F.max(F.when(green, F.struct(at, id))).alias("_green"))
    red = done.where(~green).join(last, list(by)).where(F.col("_green").isNull() | (F.struct(at, id) > F.col("_green")))
    return red.groupBy(*by).agg(F.min(at).alias("red_since"), F.count("*").alias("n_red"), F.first(F.col("_green").isNull()).alias("lower_bound"))


def drift(before: DataFrame, after: DataFrame, on: Sequence[str], count: str = "count", error: str | None = None, pct: float = 0.20, absolute: int = 5, repo: str | None = None) -> DataFrame:
    """What changed between two snapshots: on, before, after, kind.

    The kinds are tried in order: errored (also if it is new), or still-errored if it erred before without a count, gone,
    recovered or new, blind (fell to 0), jump (grew by more than ``absolute`` and by more than ``pct``). Rows without a kind
    fall out. ``repo``: one of ``on``; only repositories that both snapshots have are compared, and one that
    lacks in the later snapshot is told by ``repo_gone``.
    """
    if repo is not None:
        before, after = (x.join(y.select(repo).distinct(), repo, "left_semi") for x, y in ((before, after), (after, before)))
    none = F.lit(None).cast("string")
    a = before.select(*on, F.col(count).alias("before"), (F.col(error) if error else none).alias("_be"), F.lit(True).alias("_b"))
    b = after.select(*on, F.col(count).alias("after"), (F.col(error) if error else none).alias("_ae"), F.lit(True).alias("_a"))
    x, y = F.col("before"), F.col("after")
    kind = (
        F.when(F.col("_ae").isNotNull(), F.when(F.col("_be").isNotNull() & x.isNull(), F.lit("still-errored")).otherwise(F.lit("errored")))
        .when(y.isNull() & x.isNotNull(), F.lit("gone"))
        .when(x.isNull() & y.isNotNull(), F.when(F.col("_be").isNotNull(), F.lit("recovered")).otherwise(F.lit("new")))
        .when((x > 0) & (y == 0), F.lit("blind"))
        .when((y - x > absolute) & (y > x * (1 + pct)), F.lit("jump"))
    )
    return a.join(b, list(on), "full_outer").select(*on, "before", "after", kind.alias("kind")).where("kind is not null")


def repo_gone(before: DataFrame, after: DataFrame, repo: str = "repo") -> DataFrame:
    """Repositories of the earlier snapshot that the later one lacks."""
    return before.select(repo).distinct().join(after.select(repo), repo, "left_anti").withColumn("kind", F.lit("repo-gone"))


def merge_shards(shards: Sequence[DataFrame], repo: str = "repo") -> DataFrame:
    """The union of per-shard snapshots; a repository in two shards is an error when the result is read."""
    parts = [s.withColumn("_shard", F.lit(k)) for k, s in enumerate(shards)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    n = union.groupBy(repo).agg(F.countDistinct("_shard").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("in two shards: "), F.col(repo)))).otherwise(F.col(repo)).cast("string")
    return union.join(n, repo).withColumn(repo, checked).drop("_shard", "_n")


def age_bands(rows: DataFrame, at: str, now: Column, max_age_days: int, warn_days: int) -> DataFrame:
    """age_days and band: ``stale`` beyond ``max_age_days``, ``warn`` in the last ``warn_days`` before, else null."""
    age = F.datediff(now, F.col(at))
    return rows.withColumn("age_days", age).withColumn("band", F.when(age > max_age_days, F.lit("stale")).when(age > max_age_days - warn_days, F.lit("warn")))
