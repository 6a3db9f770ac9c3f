"""Sinks and scans: what the given tables hold is written in each format, read back pruned and typed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.plans import model_queries as M
from tempora.plans import views as V
from tempora.plans.registry import registry
from tempora.sources import tables as T

QUERIES, ORACLE_SQL, query, r6 = registry()


@query(f"SELECT 'eeg' AS modality, class AS subject, stimulus AS condition, ((component - 1) // 8)::INT AS tp, ((component - 1) % 8)::INT AS channel, round(value, 6) AS value FROM ({V.FEAT}) WHERE split = 'test' AND class = 3")
def scan_epochs(spark, d):
    """Epochs partitioned by modality, subject and split; one subject's test split is all that is read."""
    path = T.shared_path(spark, "epochs")
    split = V.v_vectors(spark, d).select("stimulus", "split")
    rows = M.v_points(spark, d).join(split, "stimulus").select(F.lit("eeg").alias("modality"), F.col("class").alias("subject"), "split", F.col("stimulus").alias("condition"), "tp", "x")
    T.write_partitioned(rows, path, ["modality", "subject", "split"])
    found = T.read_epochs(spark, path, modality="eeg", subject=3, split="test")
    return r6(found.select("modality", F.col("subject").cast("int").alias("subject"), "condition", "tp", F.posexplode("x").alias("channel", "value")), "value")


_NAMED = f"SELECT CASE WHEN component <= 32 THEN 'low' ELSE 'high' END AS feature, stimulus, split, (component - 1) % 32 AS place, value FROM ({V.FEAT})"


def _features(spark, d):
    parts = F.array(F.struct(F.lit("low").alias("name"), F.slice("x", 1, 32).alias("x")), F.struct(F.lit("high").alias("name"), F.slice("x", 33, 32).alias("x")))
    return V.v_vectors(spark, d).select("stimulus", "split", F.inline(parts))


@query(f"SELECT feature, stimulus, round(sum(value), 6) AS total FROM ({_NAMED}) WHERE feature = 'high' AND split = 'val' GROUP BY ALL")
def scan_features(spark, d):
    """Vectors partitioned by feature and split; the named features of one split are read."""
    path = T.shared_path(spark, "features")
    T.write_partitioned(_features(spark, d).withColumnRenamed("name", "feature"), path, ["feature", "split"])
    found = T.read_features(spark, path, ["high"], split="val")
    return r6(found.select("feature", "stimulus", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total")), "total")


@query(f"SELECT tp, channel, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM ({M._beta_sql('2.0').replace('v.x[1] AS x', 'v.x[33] AS x')})")
def swap_activations(spark, d):
    """The default fit with its regressors read from another layer of stored activations."""
    path = T.shared_path(spark, "activations")
    T.write_partitioned(_features(spark, d).withColumnRenamed("name", "layer"), path, ["layer", "split"])
    layer = T.read_activations(spark, path, "high", "train").select("stimulus", F.col("x")[0].alias("x"))
    rows = M.v_xy(spark, d).filter("split = 'train'").drop("x").join(layer, "stimulus")
    return r6(M.L.ridge_one(rows, ["tp", "channel"], 2.0), "slope", "intercept")


@query("SELECT p_partkey::BIGINT AS stimulus, (p_partkey % 3)::INT AS split_code, p_size::INT AS action_code FROM part")
def scan_csv(spark, d):
    """A table of stimuli as CSV without a header, read with its schema."""
    path = T.shared_path(spark, "stimuli")
    rows = T.read_table(spark, d, "part").select("p_partkey", F.col("p_partkey") % 3, "p_size")
    rows.write.csv(path)
    return T.read_csv(spark, path)


@query("""SELECT l_suppkey::BIGINT AS subject, l_linenumber::BIGINT AS behav_trigger, l_returnflag AS category, count(*) AS n, sum(l_quantity)::DOUBLE AS reaction_time
          FROM lineitem GROUP BY ALL""")
def scan_behaviour(spark, d):
    """The behaviour log as CSV with a header, every column text, read back typed."""
    path = T.shared_path(spark, "behaviour")
    source = {"subject": "l_suppkey", "img": "l_partkey", "img_type": "l_linenumber", "path": "l_shipdate", "category": "l_returnflag", "response": "l_linestatus", "trial": "l_orderkey", "behav_trigger": "l_linenumber", "correct": "l_linenumber", "onset": "l_discount", "reaction_time": "l_quantity"}
    T.write_csv(T.read_table(spark, d, "lineitem").select(*[F.col(c).cast("string").alias(n) for n, c in source.items()]), path)
    return T.read_behaviour(spark, path).groupBy("subject", "behav_trigger", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("reaction_time").alias("reaction_time"))
