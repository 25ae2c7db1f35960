"""Numbers and running totals in an order, over groups of any size: no group has to fit into one task.

Rows are dealt to ranges of (group, order) and written; each range totals what it holds of each group, and what stands
before a range in its group is a running total over one row a range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.sources.shared import cut


def running_total(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with `name`: the total of `value` over the group's rows up to this one.

    order must tell the rows of a group apart, or the result of ties is open. Null groups are one group."""
    keys = [F.col(g) for g in group]
    dealt = cut(rows.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part", *group).agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], before.alias("__before"))
    inside = F.sum("__value").over(W.partitionBy("__part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)], F.col("__part") == F.col("__p"))
    joined = dealt.withColumn("__inside", inside).join(totals, same)
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).select(*rows.columns, name)


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`: 1, 2, 3, ... within each group, in order."""
    return running_total(rows, group, order, F.lit(1).cast("long"), name)


def free_numbers(groups: DataFrame, group: list[str], order: list[Column], held: DataFrame, least: int, name: str) -> DataFrame:
    """groups with `name`: for each row in order the least number from `least` on that the group doesn't hold (held: group, number).

    Of the numbers a group holds, the j-th in order has `number - least - (j - 1)` free ones below it; so the k-th row takes
    least + k - 1 and as many more as there are held numbers with fewer than k free ones below them."""
    wanted = numbered(groups, group, order, "__k")
    taken = held.select(*group, F.col("number").cast("long").alias("__n")).filter(F.col("__n") >= least).distinct().join(groups.select(*group).distinct(), group, "left_semi")
    below = numbered(taken, group, [F.col("__n")], "__j").select(*group, (F.col("__n") - least - F.col("__j") + 1).alias("__at"), F.col("__n").alias("__tie"))
    # members and held numbers in one order; a held number counts for the members after it
    members = wanted.select(*group, F.col("__k").alias("__at"), F.lit(0).alias("__held"), F.lit(None).cast("long").alias("__tie"))
    both = running_total(members.unionByName(below.withColumn("__held", F.lit(1))), group, [F.col("__at"), F.col("__held"), F.col("__tie")], F.col("__held").cast("long"), "__more")
    counts = both.filter("__held = 0").select(*group, F.col("__at").alias("__k"), "__more")
    return wanted.join(counts, [*group, "__k"]).withColumn(name, F.col("__k") + F.col("__more") + (least - 1)).select(*groups.columns, name)
