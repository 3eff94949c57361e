"""Ranks within groups of any size: ranges of the sort order, with offsets from the ranges' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundline.llm.base import Scratch

#: monotonically_increasing_id keeps the partition above this bit and the row below it.
ROW_BITS = 33


def ranked(rows: DataFrame, scratch: Scratch, label: str, group: str, order: list[str]) -> DataFrame:
    """``rows`` plus rank (from 0, by ``order``, nulls first) and total, both long, within ``group`` (never null).

    Rows are dealt by ranges of (group, order), so a hot group spreads over
    tasks. Only one row for each group in each range takes part in the offsets.
    ``rows`` should be narrow and stored: range bounds are sampled from it.
    Columns ``rank``, ``total`` and ``at`` must not be among its own.
    """
    by = [group, *order]
    placed = scratch.write(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("at", ROW_BITS).alias("part"), F.col("at").bitwiseAND((1 << ROW_BITS) - 1)
    runs = placed.groupBy(group, part).agg(F.min(place).alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("here").over(Window.partitionBy(group)).alias("total"))
    return (placed.withColumn("part", part).join(runs, [group, "part"])
            .withColumn("rank", place + F.col("shift")).drop("part", "shift", "at"))
