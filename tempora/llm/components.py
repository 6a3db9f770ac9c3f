"""Connected components by contraction: links shrink with each round and never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def _through(df: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by what ``step`` (id, root) maps it to, if anything."""
    found = df.join(step.select(F.col("id").alias("_id"), F.col("root").alias("_root")), F.col(column) == F.col("_id"), "left")
    return found.withColumn(column, F.coalesce("_root", column)).drop("_id", "_root")


def contract(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b): root is the smallest id that can be reached.

    Each round hooks every id to its smallest smaller neighbour, follows these hooks to their
    ends by pointer jumping, and replaces the links by those between the ends.  Ends at least
    halve in number, so there are logarithmically many rounds.
    """
    links = write_table(links.filter("a <> b").distinct(), "links")
    total = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("root")))
        hooks = write_table(both.groupBy("id").agg(F.min("root").alias("root")).withColumn("root", F.least("id", "root")), "hooks")
        while True:
            jumped = write_table(_through(hooks.withColumn("was", F.col("root")), "root", hooks), "hooks")
            still = jumped.filter("root <> was").isEmpty()
            drop_table(hooks)
            hooks = jumped.drop("was")
            hooks._written_to = jumped._written_to
            if still:
                break
        total = hooks if total is None else _through(total, "root", hooks)
        shrunk = write_table(_through(_through(links, "a", hooks), "b", hooks).filter("a <> b").distinct(), "links")
        drop_table(links)
        links = shrunk
    return links.selectExpr("a AS id", "b AS root") if total is None else total


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots (id, root) of all ids in ``roots`` or ``links`` once ``links`` (a, b) are added."""
    if roots is None:
        return write_table(contract(links), "roots")
    step = contract(_through(_through(links, "a", roots), "b", roots))
    grown = _through(roots, "root", step).unionByName(step.join(roots.select("id"), "id", "left_anti"))
    return write_table(grown, "roots")
