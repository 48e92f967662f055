"""Rows as text: JSON Lines, CSV, Markdown, logfmt, raw; snapshots of a table with its anchors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import csv_cell, markdown_cell, single_line

VERSION = 1
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _shown(df: DataFrame, name: str) -> Column:
    c, t = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return single_line(c.cast("string"))


def to_json_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """value: one object a row of its fields that are not null. Times are ISO with six decimals and Z, doubles that are not
    finite are null, whole doubles get .0."""
    parts = []
    for name in columns or df.columns:
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            text = F.concat(F.lit('"'), F.date_format(c, STAMP), F.lit('Z"'))
        elif isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType):
            text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), "null").otherwise(c.cast("string"))
        elif isinstance(t, (T.IntegralType, T.DecimalType, T.BooleanType)):
            text = c.cast("string")
        else:
            text = F.replace(F.substring(F.to_json(F.struct(c.cast("string").alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.cast("string").alias("v")))) - 6), F.lit("\\/"), F.lit("/"))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(json.dumps(name, ensure_ascii=False)), F.lit(":"), text)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def to_csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.concat_ws(",", *(csv_cell(_shown(df, c)) for c in columns or df.columns)).alias("value"))


def csv_header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in columns)


def to_markdown_lines(df: DataFrame, order: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """position, value: the table's rows; the header is at position -2, its rule at -1."""
    names = columns or df.columns
    spark = df.sparkSession
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("position"), line([markdown_cell(F.lit(c)) for c in names]).alias("value")), F.struct(F.lit(-1).cast("long").alias("position"), F.lit("|" + " --- |" * len(names)).alias("value")))).alias("e")).select("e.*")
    return head.unionByName(df.select(F.col(order).cast("long").alias("position"), line([markdown_cell(_shown(df, c)) for c in names]).alias("value")))


def to_logfmt_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """key=value pairs; values with blanks, quotes or = are quoted, nulls left out."""
    parts = []
    for name in columns or df.columns:
        text = F.col(f"`{name}`").cast("string")
        escaped = text
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(a), F.lit(b))
        quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f"{name}="), F.when(text.rlike(r'[\s="\\]') | (text == ""), quoted).otherwise(text))))
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def to_plain_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fields joined by blanks, as a template's record reads."""
    return df.select(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in columns or df.columns)).alias("value"))


def raw_lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("raw").alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str | None = None, most: int = 0) -> None:
    """most: lines of a file at most; 0 is no limit."""
    lines.select("value").write.option("compression", compression or "none").option("maxRecordsPerFile", most).text(path)


def write_snapshot(df: DataFrame, path: str, anchors: DataFrame | None = None) -> None:
    """rows, anchors and meta under path. df has source, line_id and row_id (its place in the snapshot)."""
    from logloom.operators.annotate import remap_anchors

    df.write.parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.parquet(f"{path}/rows")
    if anchors is not None:
        remap_anchors(anchors, rows).write.parquet(f"{path}/anchors")
    rows.agg(F.lit(VERSION).alias("version"), F.count(F.lit(1)).alias("rows"), F.lit(df.schema.json()).alias("schema")).write.json(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot; ValueError if the version is newer or the number of rows is not the one written."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta["version"] > VERSION:
        raise ValueError(f"snapshot version {meta['version']} is newer than {VERSION}")
    rows = spark.read.parquet(f"{path}/rows")
    if (n := rows.count()) != meta["rows"]:
        raise ValueError(f"the snapshot has {n} rows, not the {meta['rows']} written")
    return rows
