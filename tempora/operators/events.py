"""Event tables: trigger decoding, epoching, audits, averages, baselines and pseudo-trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rng import draw

#: Control codes that mark no stimulus.
CONTROL_CODES = (10001, 10002, 10003, 99999)


def decode_triggers(events: DataFrame, key: str = "subject", order: str = "ord", code: str = "code", at: str = "t") -> DataFrame:
    """(key, ord, trigger, at): each two consecutive events give one four-digit id; code 255 means 0; the first one's time counts."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    digits = F.when(F.col(code) == 255, 0).otherwise(F.col(code))
    pairs = events.select(key, F.floor(place / 2).alias("ord"), (place % 2).alias("half"), digits.alias("d"), F.col(at).alias("at"))
    return pairs.groupBy(key, "ord").agg(F.max(F.when(F.col("half") == 0, F.col("d"))).alias("hi"), F.max(F.when(F.col("half") == 1, F.col("d"))).alias("lo"), F.min("at").alias("at")).filter("lo IS NOT NULL").select(
        key, "ord", F.format_string("%02d%02d", F.col("hi").cast("int"), F.col("lo").cast("int")).alias("trigger"), "at"
    )


def reconcile(triggers: DataFrame, log: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(key, matched, mismatched, only_left, only_right) for each first key, after a full join on ``keys``."""
    both = triggers.withColumn("_l", F.lit(1)).join(log.withColumn("_r", F.lit(1)), keys, "full")
    inside = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.groupBy(keys[0]).agg(
        F.count_if(inside & (F.col(left) == F.col(right))).alias("matched"), F.count_if(inside & ~F.col(left).eqNullSafe(F.col(right))).alias("mismatched"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def range_join(onsets: DataFrame, samples: DataFrame, key: str, onset: str, at: str, before: int, after: int) -> DataFrame:
    """Samples with ``onset - before <= at < onset + after`` (whole numbers): an equi-join on buckets one window wide.

    Every window touches two buckets at most, so each onset is doubled and each sample stays single.
    """
    width = before + after
    first = F.floor((F.col(onset) - before) / width)
    spread = onsets.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    met = spread.join(samples.withColumn("_bucket", F.floor(F.col(at) / width)), [key, "_bucket"])
    return met.filter((F.col(at) >= F.col(onset) - before) & (F.col(at) < F.col(onset) + after)).drop("_bucket")


def spread_onsets(sequences: DataFrame, onset: str, count: int = 10, step: int = 400) -> DataFrame:
    """One row for each stimulus of a sequence: its place and its onset."""
    return sequences.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("stimulus_onset", F.col(onset) + F.col("position") * step)


def baseline_corrected(epochs: DataFrame, trial: list[str], value: str, inside: Column) -> DataFrame:
    """``epochs`` with ``corrected``: the value less the trial's mean over the rows that are ``inside`` its baseline."""
    base = F.avg(F.when(inside, F.col(value))).over(Window.partitionBy(*trial))
    return epochs.withColumn("corrected", F.col(value) - base)


def averaged(df: DataFrame, keys: list[str], value: str, name: str = "y") -> DataFrame:
    """Trial, channel, subject or event-related averages: the mean of ``value`` for each key."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def downsampled(df: DataFrame, keys: list[str], at: str, width: int, value: str) -> DataFrame:
    """The mean of each time bucket of ``width``."""
    return df.groupBy(*keys, F.floor(F.col(at) / width).alias("bucket")).agg(F.avg(value).alias("y"))


def repetition_audit(trials: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """(keys, n) of the conditions that don't have ``expected`` trials."""
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)


def nan_audit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, n_nan)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(value)).alias("n_nan"))


def pseudo_trials(trials: DataFrame, keys: list[str], rep: str, size: int, seed: int, value: str, within: list[str] | None = None) -> DataFrame:
    """Means of consecutive blocks of ``size`` trials in a keyed random order of each ``keys``; ``within`` are points of a trial."""
    order = trials.select(*keys, rep).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, *[F.col(k) for k in keys], F.col(rep)), rep)) - 1
    blocks = order.withColumn("block", F.floor(place / size).cast("int"))
    return trials.join(blocks, [*keys, rep]).groupBy(*keys, "block", *(within or [])).agg(F.avg(value).alias("y"))


def recoded(column: Column, codes: dict[int, int]) -> Column:
    """``column`` with codes replaced; others stay."""
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in codes.items()], column)


def one_hot(column: Column, size: int) -> Column:
    """An array of ``size`` zeros and a one at the place that ``column`` names."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == column).cast("int"))


def milliseconds(tp: Column, start: int = -400, step: int = 20) -> Column:
    return F.lit(start) + tp * step


def channels_like(df: DataFrame, pattern: str = "^O *|^P *") -> DataFrame:
    """The rows of channels whose name matches."""
    return df.filter(F.col("channel").rlike(pattern))


def without_control_codes(df: DataFrame, code: str = "code") -> DataFrame:
    return df.filter(~F.col(code).isin(*CONTROL_CODES))


def without_category(df: DataFrame, stimuli: DataFrame, category: int) -> DataFrame:
    """Rows whose stimulus isn't of the category, for features and responses alike."""
    return df.join(stimuli.filter(F.col("action_code") == category).select("stimulus"), "stimulus", "left_anti")
