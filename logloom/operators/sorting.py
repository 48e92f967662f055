"""Typed sorts. Ties always go by row, ascending; what has no value of the type comes last ascending, first descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import levels
from logloom.functions.scratch import written
from logloom.functions.text import display

ENUM_BYTES = 64


def sort_key(df: DataFrame, column: str, kind: str | None = None, mapping: dict[str, str] | None = None) -> Column:
    """The value to order by; null is the tail bucket. kind: integer, number, enum, level, text, or None for the column's own order."""
    c = F.col(f"`{column}`")
    if kind == "integer":
        if isinstance(df.schema[column].dataType, T.FractionalType):
            return F.when(~F.isnan(c.cast("double")), F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63), c.cast("double"))).cast("decimal(20,0)"))
        return c
    if kind == "enum":
        return F.when(F.octet_length(c) <= ENUM_BYTES, c)
    if kind == "level":
        return levels.level_rank(c, mapping)
    if kind == "text":
        return F.when(c.isNotNull(), display(c))
    return c  # NaN comes after all numbers and before the tail bucket, as Spark has it


def order_by(df: DataFrame, column: str, descending: bool = False, row_id: str = "row_id", kind: str | None = None, mapping: dict[str, str] | None = None) -> list[Column]:
    key = sort_key(df, column, kind, mapping)
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.col(row_id).asc()]


def sort_logs(df: DataFrame, column: str, descending: bool = False, row_id: str = "row_id", kind: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    return df.orderBy(*order_by(df, column, descending, row_id, kind, mapping))


def newest_first(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(F.col(row_id).desc())


def goto_line(df: DataFrame, line: int, row_id: str = "row_id") -> DataFrame:
    """The row of a line number that counts from 1; none if there is no such line."""
    return df.where(F.col(row_id) == line - 1) if line >= 1 else df.limit(0)


def last_lines(df: DataFrame, n: int, by: str | None = None, row_id: str = "row_id") -> DataFrame:
    """The newest n rows, of all or of each `by`."""
    if by is None:
        return df.orderBy(F.col(row_id).desc()).limit(n)
    newest = Window.partitionBy(by).orderBy(F.col(row_id).desc())
    return df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def positions(df: DataFrame, order: list[Column], name: str = "position", keep: list[str] | None = None) -> DataFrame:
    """Adds each row's place (from 0) in a total order, without a window over all rows. keep: the only columns that go along.

    Rows are range-partitioned and sorted; places inside a partition are shifted by the counts of the partitions before. The
    order's first key decides the ranges, so give an order that ends in the row's id. The sorted rows are written to the
    shared folder with their partition and place, so that both passes see the same.
    """
    rows = df.orderBy(*order)
    sorted_ = written((rows if keep is None else rows.select(*keep)).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "positions")
    counts = sorted_.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return sorted_.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_before") + F.col("_m") - F.col("_first")).cast("long")).drop("_p", "_m", "_first", "_before")
