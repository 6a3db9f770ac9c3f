"""The given tables seen as the library's inputs: as DataFrames, and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.tables import read_table


def v_signal(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("channel"), F.month("l_shipdate").alias("tp"), F.col("l_quantity").alias("value"))


def v_curve(spark: SparkSession, d: str, *features: str) -> DataFrame:
    """(subject, cohort, tp, y), and ``condition`` as ``feature`` if asked for."""
    keys = ["subject", "tp", *[F.col("condition").alias("feature")] * bool(features)]
    mean = v_signal(spark, d).groupBy(*keys).agg(F.avg("value").alias("y"))
    return mean.withColumn("cohort", F.when(F.col("subject") % 2 == 0, "a").otherwise("b"))


def v_units(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("cohort"), F.col("l_returnflag").alias("feature"), F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("unit"))
    return rows.agg(F.avg(F.col("l_discount") - 0.05).alias("v"), F.sum("l_quantity").alias("w"))


def v_feat(spark: SparkSession, d: str) -> DataFrame:
    """(stimulus, class, split, component, value), a row for each component."""
    m = F.col("vec_id") % 8
    split = F.when(m <= 5, "train").when(m == 6, "val").otherwise("test")
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("stimulus"), F.col("label").alias("class"), split.alias("split"), F.posexplode("embedding").alias("component", "value"))
    return rows.withColumn("component", F.col("component") + 1).withColumn("value", F.col("value").cast("double"))


def v_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(stimulus, class, split, x), a row for each stimulus."""
    m = F.col("vec_id") % 8
    split = F.when(m <= 5, "train").when(m == 6, "val").otherwise("test")
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("stimulus"), F.col("label").alias("class"), split.alias("split"), F.col("embedding").cast("array<double>").alias("x"))


def v_log(spark: SparkSession, d: str) -> DataFrame:
    """(subject, t, code, value); t counts microseconds."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return read_table(spark, d, "events").select(F.col("user_id").alias("subject"), micros.alias("t"), F.col("event_type").alias("code"), "value")


SIGNAL = "SELECT l_suppkey AS subject, l_returnflag AS condition, l_linenumber AS channel, month(l_shipdate)::INT AS tp, l_quantity AS value FROM lineitem"
CURVE = f"SELECT subject, tp, avg(value) AS y, CASE WHEN subject % 2 = 0 THEN 'a' ELSE 'b' END AS cohort FROM ({SIGNAL}) GROUP BY subject, tp"
CURVE_F = f"SELECT subject, tp, condition AS feature, avg(value) AS y, CASE WHEN subject % 2 = 0 THEN 'a' ELSE 'b' END AS cohort FROM ({SIGNAL}) GROUP BY subject, tp, condition"
UNITS = "SELECT l_linestatus AS cohort, l_returnflag AS feature, l_linenumber AS layer, l_suppkey AS unit, avg(l_discount - 0.05) AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL"
FEAT = "SELECT vec_id AS stimulus, label AS class, CASE WHEN vec_id % 8 <= 5 THEN 'train' WHEN vec_id % 8 = 6 THEN 'val' ELSE 'test' END AS split, unnest(range(1, 65))::INT AS component, unnest(embedding)::DOUBLE AS value FROM embeddings"
VECTORS = "SELECT vec_id AS stimulus, label AS class, CASE WHEN vec_id % 8 <= 5 THEN 'train' WHEN vec_id % 8 = 6 THEN 'val' ELSE 'test' END AS split, embedding::DOUBLE[] AS x FROM embeddings"
LOG = "SELECT user_id AS subject, epoch_us(ts) AS t, event_type AS code, value FROM events"


def draw_sql(*key: object) -> str:
    """The SQL of a keyed draw; strings are column names or expressions, numbers are literals."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(str(k) for k in key) + ")), 1, 8))::BIGINT"
