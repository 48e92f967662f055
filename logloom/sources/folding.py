"""Folding of records that continue over several lines, block by block.

Lines are cut into blocks of BLOCK by their number. Inside a block a running count of headers numbers its records;
the blocks' header counts give prefix offsets. So no window spans a whole file, and a record may reach over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import blank
from logloom.sources.lines import number_within
from logloom.sources.templates import Template

BLOCK = 65_536


def number_records(lines: DataFrame, is_header: Column, by: str = "source", order: str = "line_id", block: int = BLOCK) -> DataFrame:
    """Adds record_id: number of headers up to the line; 0 before the first."""
    rows = lines.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_head", F.coalesce(is_header, F.lit(False)).cast("int"))
    counts = rows.groupBy(by, "_block").agg(F.sum("_head").alias("_n"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_inner", F.sum("_head").over(inside))
        .join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
        .withColumn("record_id", (F.col("_before") + F.col("_inner")).cast("long"))
        .drop("_block", "_head", "_by", "_b", "_before", "_inner")
    )


def count_in_blocks(lines: DataFrame, is_header: Column, by: str = "source", order: str = "line_id", block: int = BLOCK) -> DataFrame:
    """Adds _block, _inner (number of the block's headers up to the line) and _all (the block's headers).

    A record with 0 < _inner < _all lies whole in its block: it needs nothing of other blocks, nor another shuffle to be joined."""
    rows = lines.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_head", F.coalesce(is_header, F.lit(False)).cast("int"))
    inside = Window.partitionBy(by, "_block").orderBy(order)
    upto, whole = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("_inner", F.sum("_head").over(upto)).withColumn("_all", F.sum("_head").over(whole)).drop("_head")


def fold_lines(lines: DataFrame, is_header: Column, block: int = BLOCK) -> DataFrame:
    """One row a record: source, line_id (of its header), raw (its lines). Blank lines belong to a record only if another
    of its lines follows. Lines before the first header are left to orphans()."""
    return join_records(number_records(lines, is_header & (~blank(F.col("raw"))), block=block).where("record_id > 0"))


def join_records(rows: DataFrame, *record: str) -> DataFrame:
    """The lines of each record of a source, told by record_id or the columns given, as one row, without the blank lines at its end."""
    last = F.max(F.when(~blank(F.col("raw")), F.col("line_id")))
    parts = F.array_sort(F.collect_list(F.struct("line_id", "raw")))
    out = rows.groupBy("source", *(record or ("record_id",))).agg(F.min("line_id").alias("line_id"), last.alias("_last"), parts.alias("_parts"))
    kept = F.filter("_parts", lambda p: p["line_id"] <= F.col("_last"))
    return out.select("source", "line_id", F.array_join(F.transform(kept, lambda p: p["raw"]), "\n").alias("raw"))


def orphans(lines: DataFrame, is_header: Column) -> DataFrame:
    """One error for each run of continuation lines before the first header: source, first, last, error."""
    return orphan_errors(orphan_runs(number_records(lines, is_header & ~blank(F.col("raw")))))


def orphan_runs(numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, first, last of each run of lines that are not blank and stand before the first header (record_id 0)."""
    rows = numbered.where((F.col("record_id") == 0) & (~blank(F.col("raw"))))
    rows = number_within(rows.withColumn("_part", F.floor(F.col("line_id") / block)), ["source"], ["_part"], ["line_id"], "_place")
    return rows.withColumn("_run", F.col("line_id") - F.col("_place")).groupBy("source", "_run").agg(F.min("line_id").alias("first"), F.max("line_id").alias("last")).drop("_run")


def orphan_errors(runs: DataFrame) -> DataFrame:
    count = F.col("last") - F.col("first") + 1
    where = F.when(count == 1, F.concat(F.lit("line "), (F.col("first") + 1).cast("string"))).otherwise(F.concat(F.lit("lines "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string")))
    return runs.select("source", "first", "last", F.concat(F.lit("Error on "), where, F.lit(": "), count.cast("string"), F.lit(" orphaned continuation line(s)")).alias("error"))


def indented_header(raw: Column) -> Column:
    return ~raw.rlike(r"^[ \t]")


def header(template: Template, raw: Column) -> Column:
    """Whether a line starts a record of the template."""
    if template.continuation == "indented":
        return indented_header(raw)
    if template.continuation == "untilNextHeader":
        return raw.rlike("^(?:" + (template.header_anchor or template.java).removeprefix("^") + ")")
    return F.lit(True)


def fold_indented(lines: DataFrame) -> DataFrame:
    return fold_lines(lines, indented_header(F.col("raw")))


def fold(lines: DataFrame, template: Template) -> DataFrame:
    return lines if template.continuation == "none" else fold_lines(lines, header(template, F.col("raw")))
