"""Scans and sinks: pruned Parquet reads, typed CSV reads, partitioned writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The behaviour log: three integers, three strings, three integers and two numbers.
BEHAVIOUR = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("subject", "img", "img_type")]
    + [T.StructField(n, T.StringType()) for n in ("path", "category", "response")]
    + [T.StructField(n, T.LongType()) for n in ("trial", "behav_trigger", "correct")]
    + [T.StructField(n, T.DoubleType()) for n in ("onset", "reaction_time")]
)
STIMULI = T.StructType([T.StructField("stimulus", T.LongType()), T.StructField("split_code", T.IntegerType()), T.StructField("action_code", T.IntegerType())])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset and all is one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is made once and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_epochs(spark: SparkSession, path: str, **equal: object) -> DataFrame:
    """Epochs by modality, subject, split ...: equalities on partition columns prune folders."""
    return _where(spark.read.parquet(path), equal)


def read_features(spark: SparkSession, path: str, features: list[str] | None = None, **equal: object) -> DataFrame:
    """Feature vectors of the named features, or of all."""
    rows = _where(spark.read.parquet(path), equal)
    return rows.filter(F.col("feature").isin(features)) if features else rows


def read_activations(spark: SparkSession, path: str, layer: str, split: str | None = None) -> DataFrame:
    return _where(spark.read.parquet(path), {"layer": layer} | ({"split": split} if split else {}))


def _where(df: DataFrame, equal: dict) -> DataFrame:
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType = STIMULI, header: bool = False) -> DataFrame:
    """A CSV table with a given schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, header=header)


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    """The behaviour log with its typed columns, whatever text they come as."""
    return spark.read.csv(path, schema=BEHAVIOUR, header=True)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``, by position."""
    return df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema.fields)])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def alpha_for(fits: DataFrame, best_alpha: DataFrame, per_tp: bool = False) -> DataFrame:
    """``fits`` with the alpha of its subject and feature, or of its tp too; tp 0 is a tp like any other."""
    keys = ["subject", "feature", *["tp"] * per_tp]
    chosen = best_alpha.filter(F.col("tp").isNotNull() if per_tp else F.col("tp").isNull())
    return fits.join(chosen.select(*keys, "alpha"), keys, "left")
