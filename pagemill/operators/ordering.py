"""Positions and running sums over a total order, without a task that sees all rows.

Rows are dealt by ranges of their keys and stored; each range is summed in its own task, and the sums of
the ranges before it are added. Keys should tell rows apart, so that no group of equal ones is too large for a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], name: str = "ordered") -> DataFrame:
    """df plus, for each of sums, its sum over all rows before this one in order of keys."""
    dealt = df.withColumns({f"_v_{k}": v.cast("long") for k, v in sums.items()})
    dealt = stored(dealt.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(up), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inner = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before), "_range")
    return placed.select(*df.columns, *[(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0))).alias(k) for k in sums])


def numbered(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """df plus its position in order of keys, from 0."""
    return running(df, keys, {name: F.lit(1)})


def write_lines(lines: DataFrame, keys: list[str], path: str, line_sep: str = "\n") -> str:
    """Text files of lines(line, keys...) that join, in order of their names, to one document."""
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.option("lineSep", line_sep).text(path)
    return path
