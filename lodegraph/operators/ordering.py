"""Global positions and ranks without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodegraph.operators.checkpoints import cut


def _by_range(df: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in ranges of the order with their `part`, rows before each part)."""
    spread = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return spread, before


def positions(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add `name`: 0, 1, 2 and so on in the given order."""
    spread, before = _by_range(df, *order)
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.withColumn("own", own).join(F.broadcast(before), "part").withColumn(name, F.col("own") + F.col("before") - 1).drop("part", "own", "before")


def competition_rank(df: DataFrame, name: str, value: str) -> DataFrame:
    """Add `name`: one more than the number of larger values, so that ties share a rank and leave a gap."""
    order = F.col(value).desc()
    spread, before = _by_range(df, order)  # equal values fall into one range
    own = F.rank().over(Window.partitionBy("part").orderBy(order))
    return spread.withColumn("own", own).join(F.broadcast(before), "part").withColumn(name, (F.col("own") + F.col("before")).cast("int")).drop("part", "own", "before")


def next_in_group(df: DataFrame, name: str, group: str, value: str, *order: str) -> DataFrame:
    """Add `name`: `value` of the row that follows in its group, null for a group's last.

    Rows are dealt by ranges of (group, order), so that one group may fill many
    tasks; what follows a range's last row is the first one of a later range, of
    which there is a row for each range and group.
    """
    part, inside, place, key, later = (f"{name}_{x}" for x in ("part", "inside", "place", "key", "later"))
    row = F.struct(F.col(value).alias("v"))
    spread = cut(df.repartitionByRange(group, *order).withColumn(part, F.spark_partition_id()))
    first = spread.groupBy(F.col(part).alias(place), F.col(group).alias(key)).agg(F.min_by(row, F.struct(*order)).alias("first"))
    after = first.select(place, key, F.lead("first").over(Window.partitionBy(key).orderBy(place)).alias(later))
    own = spread.withColumn(inside, F.lead(row).over(Window.partitionBy(part, group).orderBy(*order)))
    joined = own.join(F.broadcast(after), (F.col(part) == F.col(place)) & F.col(group).eqNullSafe(F.col(key)), "left")
    return joined.withColumn(name, F.coalesce(inside, later)["v"]).drop(part, inside, place, key, later)
