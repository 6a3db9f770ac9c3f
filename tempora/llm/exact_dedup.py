"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

A text is compared without its white space.  Two 64-bit hashes of it only route rows: the
whole squeezed text is part of every grouping key, so equality is decided on content.

1. each task combines its own rows: the salt is the task's number, so that it ships one row for
   each text (the partial aggregate of step 2);
2. these meet by (hashes, salt, text), so that a group holding a third of all rows is
   spread over ``salts`` tasks;
3. the salt winners, at most ``salts`` for each text, meet by (hashes, text).  Only here, once for
   each text, is the SHA-256 digest made.

Rows then fetch their group's winner by the hashes, without any text; Spark's adaptive
skew join splits a hot pair there, since only the side of the rows is large.  Should two
texts ever share both hashes, their rows fetch by the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import squeeze, table, write_table

SALTS = 32
_NO_ID = 2**63 - 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the smallest id.
    A null text counts as empty; empty texts form one group.  A null id ranks behind all
    others.  Repeated rows (the same id and text) are rows of their own: each counts in
    ``group_size``, and all whose id is ``keep_id`` are kept.  Other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("decimal(38,0)").alias("points"),
        squeeze(F.col(text_col)).alias("body"),
    ).withColumns({"a": F.xxhash64("body"), "b": F.xxhash64("body", F.lit(1))})
    # One number orders (points descending, id ascending): a plain maximum keeps these hash aggregates.
    points, order = F.col("points") * F.lit(str(2**64)).cast("decimal(38,0)"), F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("decimal(38,0)")
    route = ["a", "b"]
    salted = (
        rows.withColumns({"salt": F.pmod(F.spark_partition_id(), F.lit(salts)), "rank": (points - order).cast("decimal(38,0)")})
        .groupBy(*route, "salt", "body")
        .agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.count(F.lit(1)).alias("n"))
    )
    groups = salted.groupBy(*route, "body").agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.sum("n").alias("group_size"))
    best = F.nullif((points - F.col("rank")).cast("long"), F.lit(_NO_ID))
    winners = write_table(groups.select(*route, F.sha2("body", 256).alias("digest"), best.alias("keep_id"), "group_size"), "exact-winners")
    shared = write_table(winners.groupBy(*route).count().filter("count > 1").select(*route), "exact-shared")
    plain = rows.select("doc_id", *route)
    if shared.isEmpty():
        return _fetched(plain, winners, route)
    odd = rows.join(shared, route, "left_semi").withColumn("digest", F.sha2("body", 256))
    even = _fetched(plain.join(shared, route, "left_anti"), winners, route)
    return even.unionByName(_fetched(odd.select("doc_id", "digest"), winners.join(shared, route, "left_semi").drop(*route), ["digest"]))


def _fetched(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(groups, on).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
             g AS (SELECT body, count(*) AS group_size FROM t GROUP BY body),
             k AS (SELECT body, doc_id AS keep_id FROM t
                   QUALIFY row_number() OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST) = 1)
        SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM k.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g USING (body) JOIN k USING (body)"""
}
