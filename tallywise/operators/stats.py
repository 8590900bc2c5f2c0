"""Outliers, distributions and changes over an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.fixed_values import HISTOGRAM_BINS, OUTLIER_THRESHOLD
from tallywise.functions.numbers import change_pct, percent, round_to


def zscore_outliers(
    df: DataFrame, value_col: str, threshold: float = OUTLIER_THRESHOLD, tie_breaker: str | None = None
) -> DataFrame:
    """Population z-score of a column (2 places) and whether it reaches the threshold.

    Mean and deviation come from a scalar subquery, so rows keep their partitioning
    and no window pulls the table into one task. Without spread every score is 0.
    """
    value = F.col(value_col).cast("double")
    spread = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).alias("s"))
    std = F.col("_spread.std")
    score = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(
        round_to((value - F.col("_spread.mean")) / std)
    )
    order = [F.desc_nulls_last("zscore")]
    if tie_breaker:
        order.append(F.asc_nulls_last(tie_breaker))
    return (
        df.withColumn("_spread", spread.scalar())
        .withColumn("zscore", score)
        .drop("_spread")
        .withColumn("is_outlier", F.coalesce(F.abs("zscore") >= threshold, F.lit(False)))
        .orderBy(*order)
    )


def period_change(trend: DataFrame, period: str = "period", value: str = "revenue") -> DataFrame:
    """Change against the previous period in percent (1 place); the first period is
    left out, and after a period of zero the change is null.

    Expects an aggregated series: the ordering runs over its few rows, not over facts.
    """
    ordered = Window.orderBy(period)
    return (
        trend.withColumn("change_pct", round_to(change_pct(value, F.lag(value).over(ordered)), 1))
        .withColumn("_first", F.row_number().over(ordered) == 1)
        .filter(~F.col("_first"))
        .drop("_first")
        .orderBy(period)
    )


def margin_trend(trend: DataFrame, period: str = "period") -> DataFrame:
    """Margin per period; null where a period has no revenue."""
    return trend.withColumn("margin_pct", round_to(percent("profit", "revenue"))).orderBy(period)


def histogram(df: DataFrame, value_col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty ones included."""
    value = F.col(value_col).cast("double")
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo is not null")
    limits = bounds.select(F.struct("lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"))).scalar()
    place = F.floor(F.try_divide(F.col("value") - F.col("limits.lo"), F.col("limits.width")))
    counts = (
        df.filter(value.isNotNull())
        .select(value.alias("value"), limits.alias("limits"))
        .groupBy((F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)) + 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    edges = bounds.select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
        "lo",
        ((F.col("hi") - F.col("lo")) / bins).alias("width"),
    )
    return (
        edges.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_end"),
            F.coalesce("records", F.lit(0)).alias("records"),
        )
        .orderBy("bin")
    )


def quartiles(
    df: DataFrame, group_col: str, value_col: str, slices: int = 64, few_groups: bool = False
) -> DataFrame:
    """Exact quartiles (linear interpolation), extremes and row count per group.

    An exact percentile aggregate would hold all values of a group in one task. Here
    values are counted per (group, value), then cut into ``slices`` ranges per group
    with about the same number of different values (a fixed-size sketch finds the
    cuts). Slice totals tell which slices hold the wanted ranks; only those are ranked
    value by value, each in its own task. The cuts only decide how the work is spread,
    never the result.

    ``few_groups`` promises that the number of groups is bounded (a top-k); cuts and
    wanted ranks are then broadcast instead of moving the counted values by group.
    """
    small = F.broadcast if few_groups else (lambda side: side)
    counts = (
        df.filter(F.col(value_col).isNotNull())
        .groupBy(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy(F.col("g").alias("cut_g")).agg(
        F.percentile_approx("v", shares, 10 * slices).alias("cuts")
    )
    sliced = counts.join(small(cuts), F.col("g").eqNullSafe(F.col("cut_g"))).select(
        "g", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("slice")
    )
    totals = sliced.groupBy("g", "slice").agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    in_order = Window.partitionBy("g").orderBy("slice")
    whole = Window.partitionBy("g")
    ranked = totals.select(
        "g",
        "slice",
        (F.sum("n").over(in_order) - F.col("n")).alias("before"),
        "n",
        F.sum("n").over(whole).alias("records"),
        F.min("low").over(whole).alias("low"),
        F.max("high").over(whole).alias("high"),
    )
    first, last = F.col("before"), F.col("before") + F.col("n") - 1

    def point(q: float) -> Column:
        place = F.lit(q) * (F.col("records") - 1)
        return F.struct(
            F.lit(q).alias("q"),
            F.floor(place).alias("lower"),
            F.ceil(place).alias("upper"),
            (place - F.floor(place)).alias("part"),
        )

    # The ranks a slice has to answer; most slices have none and drop out here.
    asked = ranked.select(
        F.col("g").alias("asked_g"),
        F.col("slice").alias("asked_slice"),
        "before",
        "records",
        "low",
        "high",
        F.filter(
            F.array(*[point(q) for q in (0.25, 0.5, 0.75)]),
            lambda p: p["lower"].between(first, last) | p["upper"].between(first, last),
        ).alias("points"),
    ).filter(F.size("points") > 0)
    same_slice = F.col("g").eqNullSafe(F.col("asked_g")) & (F.col("slice") == F.col("asked_slice"))
    within = Window.partitionBy("g", "slice").orderBy("v")
    values = (
        sliced.join(small(asked), same_slice)
        .withColumn("to", F.col("before") + F.sum("n").over(within) - 1)
        .withColumn("from", F.col("to") - F.col("n") + 1)
        .select("g", "v", "from", "to", "records", "low", "high", F.inline("points"))
    )
    lower_value = F.max(F.when(F.col("lower").between(F.col("from"), F.col("to")), F.col("v")))
    upper_value = F.max(F.when(F.col("upper").between(F.col("from"), F.col("to")), F.col("v")))
    points = values.groupBy("g", "q").agg(
        (lower_value + (upper_value - lower_value) * F.max("part")).alias("point"),
        F.max("records").alias("records"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
    )
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("point")))
    return points.groupBy(F.col("g").alias(group_col)).agg(
        F.max("records").alias("records"),
        F.max("low").alias("minimum"),
        at(0.25).alias("q1"),
        at(0.5).alias("median"),
        at(0.75).alias("q3"),
        F.max("high").alias("maximum"),
    )
