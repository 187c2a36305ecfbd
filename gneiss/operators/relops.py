"""The recurring relational shapes of audit queries.

All are declarative joins and aggregations on keys: map-side partial aggregates, and joins for which the
optimizer picks the strategy. No side is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_support(claims: DataFrame, support: DataFrame, on: Sequence[str]) -> DataFrame:
    """Claims that no row of ``support`` backs. A null key is backed by nothing."""
    return claims.join(support.select(*on), list(on), "left_anti")


def with_support(claims: DataFrame, support: DataFrame, on: Sequence[str]) -> DataFrame:
    return claims.join(support.select(*on), list(on), "left_semi")


def parity(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that one side lacks: the key columns and side, ``left_only`` or ``right_only``."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(True))
    b = right.select(*on).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(on), "full_outer").where("_l is null or _r is null")
    return both.select(*on, F.when(F.col("_r").isNull(), F.lit("left_only")).otherwise(F.lit("right_only")).alias("side"))


def differing(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of equal key whose values differ: key, <v>_left, <v>_right. Nulls are equal to nulls only; numbers may be ``tolerance`` apart."""
    a = left.select(*on, *[F.col(v).alias(f"{v}_left") for v in values])
    b = right.select(*on, *[F.col(v).alias(f"{v}_right") for v in values])

    def differs(v: str) -> Column:
        x, y = F.col(f"{v}_left"), F.col(f"{v}_right")
        if tolerance:
            return F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
        return ~x.eqNullSafe(y)

    return a.join(b, list(on)).where(reduce(lambda p, q: p | q, map(differs, values)))


def groups_having(rows: DataFrame, by: Sequence[str], having: Column | str, **aggregates: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()]).where(having)


def majority_outliers(rows: DataFrame, family: Sequence[str], guarded: str, min_family: int = 3, min_share: float = 0.6) -> DataFrame:
    """The unguarded members of families in which most members are guarded.

    Family sizes come from a grouped aggregate and a join, not from a window, so a large family is spread over tasks.
    """
    g = F.coalesce(F.col(guarded), F.lit(False))
    sums = rows.groupBy(*family).agg(F.count("*").alias("family_size"), F.count_if(g).alias("guarded_count"))
    odd = sums.where((F.col("family_size") >= min_family) & (F.col("guarded_count") >= min_share * F.col("family_size")) & (F.col("guarded_count") < F.col("family_size")))
    return rows.where(~g).join(odd, list(family))


def contained(inner: DataFrame, outer: DataFrame, on: Sequence[str], point: str, start: str, end: str, cell: int = 256) -> DataFrame:
    """Pairs of a point and a span of the same key that holds it.

    Spans are cut into cells of ``cell`` units, so the range condition rides on an equi-join.
    """
    a = inner.withColumn("_cell", F.floor(F.col(point) / cell))
    b = outer.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    return a.join(b, [*on, "_cell"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_cell")


def holders_of_all(has: DataFrame, wanted: DataFrame, holder: str, value: str) -> DataFrame:
    """Relational division: holders that have every wanted value. No wanted value: every holder."""
    need = wanted.select(value).distinct()
    n = need.agg(F.count("*").alias("_need"))
    got = has.select(holder, value).distinct().join(need.withColumn("_hit", F.lit(1)), value, "left").groupBy(holder).agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("_got"))
    return got.crossJoin(F.broadcast(n)).where("_got = _need").select(holder)  # the broadcast side is one row


def last_before(rows: DataFrame, marks: DataFrame, on: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """As-of join: the ``value`` of the last mark of the key at or before each row's time, by one window over both."""
    from pyspark.sql import Window as W

    a = rows.withColumn("_value", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_row", F.lit(1))
    b = marks.select(*on, time, F.col(value).alias("_value")).withColumn("_row", F.lit(0))
    w = W.partitionBy(*on).orderBy(time, "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    return a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_row = 1").drop("_value", "_row")
