"""Statistics with defined edges: ranks, correlations and moments that survive NaN, ties and constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds the rank of ``value`` within its group, ties sharing their mean rank.

    Values are counted first; the running count over distinct values goes in two levels (range buckets of
    the group's quantiles, then within a bucket), so no task sorts a hot group.
    """
    from pyspark.sql import Window as W

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, F.lit([k / buckets for k in range(1, buckets)]), F.lit(10 * buckets)).alias("_cuts"))
    counts = counts.join(cuts, list(by)).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: F.col(value) > c))).drop("_cuts")
    sums = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_start", start).drop("_sum")
    inner = F.coalesce(F.sum("_n").over(W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_own", inner).join(sums, [*by, "_bucket"])
    ranks = ranks.select(*by, value, (F.col("_start") + F.col("_own") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranks, [*by, value])


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, min_pairs: int = 3) -> DataFrame:
    """by, n, rho: correlation of average ranks. Pairs with NaN or null are left out; too few pairs or a constant side give NaN."""
    ok = rows.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    ranked = average_ranks(average_ranks(ok, by, "_x", "_rx"), by, "_y", "_ry")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    nan = F.lit(float("nan"))
    return out.select(*by, "n", F.when((F.col("n") < min_pairs) | (F.col("_sx") == 0) | (F.col("_sy") == 0) , nan).otherwise(F.try_divide("_c", F.col("_sx") * F.col("_sy"))).alias("rho"))


def moments(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, variance, skewness (both of the population) by the engine's stable one-pass updates, and ``raw_variance`` from plain power sums, which cancels."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
        F.skewness(v).alias("skewness"),
        (F.avg(v * v) - F.avg(v) * F.avg(v)).alias("raw_variance"),
    )


#: Fixed cases of the edge matrix: y_true, y_pred, weight.
NAN, INF = float("nan"), float("inf")
EDGE_CASES: dict[str, list[tuple[int | None, float | None, float]]] = {
    "empty": [],
    "one_row": [(1, 0.5, 1.0)],
    "constant": [(1, 0.5, 1.0)] * 4,
    "single_class": [(1, 0.2, 1.0), (1, 0.4, 1.0), (1, 0.9, 1.0)],
    "all_nan": [(0, NAN, 1.0), (1, NAN, 1.0), (1, NAN, 1.0)],
    "some_nan": [(0, 0.1, 1.0), (1, NAN, 1.0), (1, 0.8, 1.0), (0, 0.3, 1.0)],
    "inf": [(0, 0.1, 1.0), (1, INF, 1.0), (0, -INF, 1.0), (1, 0.4, 1.0)],
    "ties_heavy": [(0, 0.5, 1.0), (1, 0.5, 1.0), (0, 0.5, 1.0), (1, 0.7, 1.0)],
    "float32_extreme": [(0, 3.4e38, 1.0), (1, -3.4e38, 1.0), (1, 1.2e-38, 1.0)],
    "subnormal": [(0, 5e-324, 1.0), (1, 1e-310, 1.0), (1, 0.0, 1.0)],
    "zero_weight": [(0, 0.1, 0.0), (1, 0.9, 0.0), (1, 0.5, 0.0)],
}


def edge_rows(spark) -> DataFrame:
    """case, i, y_true, y_pred, weight for each named edge case; ``empty`` has no row."""
    rows = [(c, i, *r) for c, rs in EDGE_CASES.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "case string, i int, y_true bigint, y_pred double, weight double")


def error_ancestors() -> dict[str, list[str]]:
    """Each built-in exception and all classes it is one of."""
    import builtins

    kinds = [x for x in vars(builtins).values() if isinstance(x, type) and issubclass(x, BaseException)]
    return {k.__name__: [c.__name__ for c in k.__mro__ if issubclass(c, BaseException)] for k in kinds}


def edge_verdicts(results: DataFrame, contracts: DataFrame) -> DataFrame:
    """(case, value, error) against (case, contract): case, contract, ok.

    error is the name of the exception's class, or null. A division by zero, an index out of range or a runtime
    warning meets no contract. Else: ``any`` takes all; ``nan`` and ``finite`` a result of that kind; ``no_crash`` any result, a
    ValueError or a TypeError (or a built-in subclass); ``nan_or_valueerror`` NaN or those two; ``raise:<Error>`` that error or
    a built-in subclass. Another contract is an error when the verdicts are read; a case without a result meets none but ``any``.
    """
    known = F.create_map(*[x for k, up in sorted(error_ancestors().items()) for x in (F.lit(k), F.lit(up))])
    v, e, c = F.col("value"), F.col("error"), F.col("contract")
    kinds = F.coalesce(F.try_element_at(known, e), F.array(e))
    isa = lambda *names: e.isNotNull() & F.arrays_overlap(kinds, F.lit(list(names)))
    nan, finite = e.isNull() & F.isnan(v), e.isNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    there, soft = e.isNull() & v.isNotNull(), isa("ValueError", "TypeError")
    ok = (
        F.when(isa("ZeroDivisionError", "IndexError", "RuntimeWarning"), F.lit(False))
        .when(c == "any", F.lit(True))
        .when(c == "nan", nan)
        .when(c == "finite", finite)
        .when(c == "no_crash", there | soft)
        .when(c == "nan_or_valueerror", nan | soft)
        .when(c.startswith("raise:"), e.isNotNull() & F.array_contains(kinds, F.substr(c, F.lit(7))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown contract: "), c)).cast("boolean"))
    )
    return contracts.join(results, "case", "left").select("case", "contract", F.coalesce(ok, F.lit(False)).alias("ok"))
