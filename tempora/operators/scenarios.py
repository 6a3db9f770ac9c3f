"""Scenario sweeps, stacked cohorts and report rows: compositions of the other operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    """One control analysis as parameters: which frames of a stimulus count, and which components are regressors (all if empty)."""

    name: str = "default"
    first_frame: int = 10
    last_frame: int = 18
    components: tuple[int, ...] = field(default=())


def framed(frames: DataFrame, scenarios: list[Scenario], key: str, frame: str = "frame", component: str = "component", value: str = "value") -> DataFrame:
    """(scenario, key, x): the mean of each component over a scenario's frames, from rows (key, frame, component, value).

    Values are summed up once along the frames of a stimulus and component; any range of frames is
    then the difference of two look-ups, so one scan serves all scenarios.  Frames that a stimulus
    lacks and null values don't count; a stimulus without any value of one of a scenario's components
    has no row for it.  Components without numbers of their own count for scenarios that name none.
    """
    upto = Window.partitionBy(key, component).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    daily = frames.filter(F.col(value).isNotNull()).groupBy(key, component, frame).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    sums = daily.select(key, component, F.struct(F.col(frame).alias("f"), F.sum("s").over(upto).alias("s"), F.sum("c").over(upto).alias("c")).alias("p"))
    packed = sums.groupBy(key, component).agg(F.sort_array(F.collect_list("p")).alias("p"))  # as many as a stimulus has frames
    kind = dict(frames.dtypes)[component]
    known = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.lit(s.first_frame).alias("first"), F.lit(s.last_frame).alias("last"), F.array(*[F.lit(c) for c in s.components]).cast(f"array<{kind}>").alias("of")) for s in scenarios])
    rows = packed.withColumn("_s", F.explode(known)).filter((F.size("_s.of") == 0) | F.array_contains("_s.of", F.col(component)))
    last = F.try_element_at(F.filter("p", lambda e: e["f"] <= F.col("_s.last")), F.lit(-1))
    before = F.try_element_at(F.filter("p", lambda e: e["f"] < F.col("_s.first")), F.lit(-1))
    ends = rows.select(F.col("_s.scenario").alias("scenario"), F.size("_s.of").alias("wanted"), key, component, last.alias("b"), before.alias("a"))
    some = lambda v: F.coalesce(v, F.lit(0))
    count = some(F.col("b.c")) - some(F.col("a.c"))
    means = ends.withColumn("mean", F.try_divide(some(F.col("b.s")) - some(F.col("a.s")), count)).filter("mean IS NOT NULL")
    every = means.groupBy("scenario", key).agg(F.sort_array(F.collect_list(F.struct(component, "mean"))).alias("x"), F.max("wanted").alias("wanted"))
    widest = every.groupBy("scenario").agg(F.max(F.size("x")).alias("most"))  # a row for each scenario
    whole = F.size("x") == F.when(F.col("wanted") > 0, F.col("wanted")).otherwise(F.col("most"))
    return every.join(F.broadcast(widest), "scenario").filter(whole).select("scenario", key, F.col("x.mean").cast("array<double>").alias("x"))


def frame_scenarios(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "scenario string, first long, last long")


def swept(df: DataFrame, scenarios: DataFrame, at: str = "tp") -> DataFrame:
    """``df`` once for each scenario whose range holds the row; scenarios are a handful."""
    return df.join(F.broadcast(scenarios), F.col(at).between(F.col("first"), F.col("last"))).drop("first", "last")


def stacked(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """The rows of all parts, labelled with their name."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(label, F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def report(curve: DataFrame, interval: DataFrame, tests: DataFrame, ceiling: DataFrame, keys: list[str], first_tp: int = 10) -> DataFrame:
    """One row for each key of the curve from ``first_tp`` on, with its interval, test and noise ceiling."""
    return curve.filter(F.col("tp") >= first_tp).join(interval, keys, "left").join(tests, keys, "left").join(ceiling, keys, "left")


def numbered_frames(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("frame", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def from_list(text: Column) -> Column:
    """A list that a configuration holds as JSON."""
    return F.from_json(text, "array<string>")
