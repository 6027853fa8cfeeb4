"""Row numbers in large groups: no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.sources.scratch import written


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Adds each row's number (from 0) in its group, by order, as out, and the group's size as out_n.

    Rows are dealt out by range, so a large group spans many tasks. Each task numbers its own part, and the parts of a
    group are offset by the sizes of those before: a table of as many rows as there are tasks and groups in them. Null
    keys are a group of their own and come first in the order. Rows that are equal in order are numbered in any order.
    """
    held = F.struct(*rows.columns).alias("row")
    keys = [F.col(f"row.{c}").alias(f"by_{i}") for i, c in enumerate(by)]
    names = [f"by_{i}" for i in range(len(by))]
    dealt = rows.select(held).select("row", *keys).repartitionByRange(*names, *[f"row.{c}" for c in order])
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*names, "part").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    upto = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"own_{c}") for c in names], F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(group).alias("all"))
    same: Column = F.col("part") == F.col("own_part")
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"own_{c}"))
    joined = dealt.hint("merge").join(sizes.hint("merge"), same)
    own = Window.partitionBy("part", *names).orderBy(*[f"row.{c}" for c in order])
    return joined.withColumn("nth", F.row_number().over(own)).select("row.*", (F.col("before") + F.col("nth") - 1).alias(out), F.col("all").alias(f"{out}_n"))
