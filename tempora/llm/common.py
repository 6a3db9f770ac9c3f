"""Spark helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that goes to a Python worker; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand Python at most ``BATCH_BYTES`` of rows at a time: whole texts vary widely in length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all is one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Ends with a query's execution, if true: its shuffle files, which else stay until the driver's next large garbage collection.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it cuts the lineage and survives lost executors.

    ``tidy`` gives the write's shuffle files back at once; the session's setting is as before afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_TIDY, "false")
    if tidy:
        spark.conf.set(_TIDY, "true")
    df.write.parquet(path)
    if tidy:
        spark.conf.set(_TIDY, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`write_table` that no later plan reads."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``; beyond, the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def squeeze(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, alike in every engine and locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_table(df: DataFrame, column: str, many: int, most: int, each: int = 16) -> tuple[np.ndarray, int]:
    """A table of bits, those set that the leading bits of ``df``'s ``many`` hashes name, and how many bits lead: ``each`` places for each, 2^``most`` at most."""
    bits = min(most, max(6, (each * many).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = df.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^(most - 6) rows at most
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words, bits
