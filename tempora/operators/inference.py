"""Rank-based p-values, false discovery rates, quantiles and peaks over resampled statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimal places to which statistics are rounded before they are ranked, so that mirrored resamples tie.
PLACES = 9


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """``df`` with the rank of ``value`` within ``keys``, ties sharing their mean rank."""
    within = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(within.orderBy(value)) + (ties - 1) / 2.0)


def rank_p(stats: DataFrame, keys: list[str], tail: str = "two-sided") -> DataFrame:
    """(keys, stat, p): p = (B + 1 - rank) / B of resample b = 0 among all B resamples in ``stats`` (keys, b, stat).

    Only the counts of smaller and equal statistics are needed, so that nothing is sorted.
    """
    size = F.round(F.abs("stat") if tail == "two-sided" else F.col("stat"), PLACES)
    sized = stats.select(*keys, "b", "stat", size.alias("size"))
    observed = sized.filter("b = 0").select(*keys, F.col("stat").alias("observed"), F.col("size").alias("limit"))
    counted = sized.join(observed, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") < F.col("limit")).alias("less"), F.count_if(F.col("size") == F.col("limit")).alias("equal"), F.first("observed").alias("stat")
    )
    return counted.select(*keys, "stat", ((F.col("n") + 1 - (F.col("less") + (F.col("equal") + 1) / 2.0)) / F.col("n")).alias("p"))


def bh_fdr(tests: DataFrame, family: list[str], alpha: float = 0.05, p: str = "p") -> DataFrame:
    """``tests`` with Benjamini-Hochberg ``p_adj`` and ``rejected`` within each family (one family of all rows if empty)."""
    keys = family or [F.lit(1)]
    ordered = Window.partitionBy(*keys).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = tests.withColumn("_rank", F.row_number().over(ordered)).withColumn("_scaled", F.col(p) * m / F.col("_rank"))
    onwards = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min("_scaled").over(onwards)))
    return adjusted.withColumn("rejected", F.col("p_adj") <= alpha).drop("_rank", "_scaled")


def nearest_rank(value: str, share: float) -> Column:
    """The value at place ceil(n * share) in order, an aggregate."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, lo, est, hi): nearest-rank bounds over resamples b > 0, and the observed value at b = 0."""
    share = (1 - level) / 2
    resampled = F.when(F.col("b") > 0, F.col(value).cast("double"))
    rows = df.withColumn("_v", resampled)
    return rows.groupBy(*keys).agg(nearest_rank("_v", round(share, 6)).alias("lo"), F.max(F.when(F.col("b") == 0, F.col(value).cast("double"))).alias("est"), nearest_rank("_v", round(1 - share, 6)).alias("hi"))


def peak(df: DataFrame, keys: list[str], at: str = "tp", value: str = "stat") -> DataFrame:
    """(keys, peak): the place of the largest value, the first on ties."""
    best = F.max(F.struct(F.round(value, PLACES).alias("v"), (-F.col(at)).alias("t")))
    return df.groupBy(*keys).agg((-best["t"]).alias("peak"))


def recentred_p(df: DataFrame, keys: list[str], value: str = "diff") -> DataFrame:
    """(keys, p): (1 + #{|x_b - x_0| > |x_0|}) / (B + 1) over the resamples b > 0."""
    observed = df.filter("b = 0").select(*keys, F.col(value).alias("_x0"))
    both = df.filter("b > 0").join(observed, keys)
    return both.groupBy(*keys).agg(((1 + F.count_if(F.round(F.abs(F.col(value) - F.col("_x0")), PLACES) > F.round(F.abs("_x0"), PLACES))) / (F.count(F.lit(1)) + 1)).alias("p"))
