"""Format of files from their first lines, many files in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import blank
from logloom.sources.formats import csv_cells
from logloom.sources.lines import read_heads
from logloom.sources.templates import Template, catalogue

PROBED, NEEDED = 8, 2


def detect_files(spark: SparkSession, path: str | list[str], extra: tuple[Template, ...] = ()) -> DataFrame:
    """detect_formats of files of any codec, of which only the heads are read."""
    return detect_formats(read_heads(spark, path, PROBED), extra)


def detect_formats(lines: DataFrame, extra: tuple[Template, ...] = ()) -> DataFrame:
    """source, format (json, logfmt, regex, csv), template (name, for regex): JSON, then logfmt, then templates by priority,
    then CSV; JSON where nothing fits. Looks at each file's first PROBED lines that are not blank."""
    full = lines.where(~blank(F.col("raw"))).select("source", "line_id", "raw")
    near = F.col("line_id") < 4 * PROBED
    # files with too few of them near their start are looked through
    sparse = full.groupBy("source").agg(F.count_if(near).alias("n"), F.max("line_id").alias("last")).where((F.col("n") < PROBED) & (F.col("last") >= 4 * PROBED)).select("source")
    place = F.row_number().over(Window.partitionBy("source").orderBy("line_id"))
    head = full.where(near).unionByName(full.where(~near).join(sparse, "source", "left_semi").withColumn("_k", place).where(F.col("_k") <= PROBED).drop("_k"))
    probes = head.groupBy("source").agg(F.slice(F.array_sort(F.collect_list(F.struct("line_id", "raw"))), 1, PROBED).alias("p")).withColumn("raws", F.transform("p", lambda p: p["raw"]))
    first, second = F.get("raws", F.lit(0)), F.get("raws", F.lit(1))
    json = first.rlike(r"^\s*+\{") & F.try_parse_json(first).isNotNull()
    logfmt = first.rlike(r'^\s*+(?![{\[])[^\s="]++=')
    template = F.lit(None).cast("string")
    for t in reversed([t for t in catalogue(extra) if t.auto_detect]):
        full = "^(?:" + t.java.removeprefix("^").removesuffix("$") + ")$"
        template = F.when(F.size(F.filter("raws", lambda r: r.rlike(full))) >= NEEDED, t.name).otherwise(template)  # noqa: B023
    cells = csv_cells(first)
    csv = (F.size(cells) >= 2) & (F.size(F.filter(cells, lambda c: F.trim(c["text"]) != "")) >= 2) & (F.size(csv_cells(second)) == F.size(cells))
    fmt = F.when(json, "json").when(logfmt, "logfmt").when(F.col("template").isNotNull(), "regex").when(F.coalesce(csv, F.lit(False)), "csv").otherwise("json")
    return probes.withColumn("template", template).select("source", fmt.alias("format"), F.when(fmt == "regex", F.col("template")).alias("template"))
