"""Physical lines of text files with their identity: source, line_id (from 0 in each file), raw."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import blank
from logloom.sources import blocks

LINE_SCHEMA = "source string, line_id bigint, raw string"


def number_within(df: DataFrame, by: list[str], block: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: the row's place (from 0) among the rows of the same `by`, ordered by `block` columns, then `order`.

    In two levels: rows are numbered inside their block, blocks get prefix sums of their counts. No window spans more
    than one block's rows, or one file's blocks.
    """
    inside = Window.partitionBy(*by, *block).orderBy(*order)
    counts = df.groupBy(*by, *block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.withColumn("_inner", F.row_number().over(inside) - 1).join(starts, [*by, *block]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner")


#: Rows of counts, one a block or file, that are broadcast at most; beyond, the join shuffles.
BROADCAST_COUNTS = 100_000


def read_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = True) -> DataFrame:
    """Lines of plain, gzip or bzip2 files; a byte order mark and the carriage return of a line end are stripped.

    One task reads a block of a file from its first line to its last, so a line's place in it is the distance of their places in the
    task: no window or sort holds the lines of a file that cannot be split."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    # one row a block
    counts = text.groupBy("source", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    few = files_of(spark, path).count() + text.rdd.getNumPartitions() <= BROADCAST_COUNTS  # a task reads one block, or several small files
    lines = text.join(F.broadcast(starts) if few else starts, ["source", "_block"])
    return clean(lines.select("source", (F.col("_at") + F.col("_shift")).cast("long").alias("line_id"), "raw"), keep_blank)


def numbered_on(lines: DataFrame, *order: Column) -> DataFrame:
    """line_id counts on over files, which follow each other by `order`, expressions of source; as far as rotated or cut files are one log."""
    counts = lines.groupBy("source").agg((F.max("line_id") + 1).alias("_n"))
    before = Window.orderBy(*order, "source").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = counts.select("source", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).persist()
    few = starts.count() <= BROADCAST_COUNTS
    return lines.join(F.broadcast(starts) if few else starts, "source").withColumn("line_id", F.col("line_id") + F.col("_before")).drop("_before")


def clean(lines: DataFrame, keep_blank: bool = True) -> DataFrame:
    raw = F.regexp_replace("raw", "\r\\z", "")
    out = lines.withColumn("raw", F.when(F.col("line_id") == 0, F.regexp_replace(raw, "^\\uFEFF", "")).otherwise(raw))
    return out if keep_blank else out.where(~blank(F.col("raw")))


#: Tasks that read pieces; of more pieces, a task reads several.
MOST_TASKS = 50_000


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to tasks by keys that differ, before work that costs more than a shuffle, as parsing does: a table of few files or row
    groups is few tasks."""
    return rows.repartition(_tasks(rows.sparkSession), *by)


def files_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source and size of the files of a path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("length").alias("size"))


def read_compressed(spark: SparkSession, path: str | list[str], most_bytes: int = 32 << 30, piece: int = 64 << 20) -> DataFrame:
    """Lines of files of any codec and length, told by content, whatever their names, in pieces of about `piece` compressed bytes where the
    codec lets one begin inside a file (see blocks.py). A piece is one task; it is decompressed as a stream, and fails beyond most_bytes.

    A line's number counts from 0 in its file. On a file system that pyarrow does not know, a file is one value and one task instead, of 2 GB compressed at most."""
    files = files_of(spark, path)
    # sizes as the listing tells them; one row
    known = files.agg(F.first("source").alias("one"), F.sum(F.ceil(F.col("size") / piece)).alias("pieces")).first()
    if known["one"] is None or blocks.reachable(known["one"]):
        return clean(blocks.read(files.repartition(_tasks(spark), "source"), piece, most_bytes, min(max(known["pieces"] or 1, 1), MOST_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, number, seen = io.BytesIO(content), 0, 0
                for lines in blocks.numbered(blocks.chunks(file, blocks.codec(content[:10]), len(content), 0, len(content)), lambda: iter(()), True):
                    seen += sum(map(len, lines))
                    if seen > most_bytes:
                        raise ValueError(f"{source} is larger than {most_bytes} bytes once decompressed")
                    yield blocks.batch(source, number, lines)
                    number += len(lines)

    return clean(spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content").mapInArrow(run, LINE_SCHEMA))


def read_heads(spark: SparkSession, path: str | list[str], wanted: int = 8) -> DataFrame:
    """The first lines of files of any codec, until `wanted` of them are not blank; no file is read further, so the work follows the
    number of files, not their length."""
    files = files_of(spark, path)
    return clean(blocks.heads(files.repartition(_tasks(spark), "source"), wanted))


#: Names of rotated files. Number, date after the name, date before the extension; a codec may follow.
_NUMBERED = r"^(.+?)\.([0-9]+)(?:\.(?:gz|bz2|xz|zst))?$"
_DATED = r"^(.+?)[-._](\d{4}-\d{2}-\d{2})(?:\.(?:gz|bz2|xz|zst))?$"
_INFIX = r"^(.+?)[-._](\d{4}-\d{2}-\d{2})\.([A-Za-z0-9]+)(?:\.(?:gz|bz2|xz|zst))?$"
NUMBER_BASE = 1_000_000_000


def rotation_order(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds rotation_family (the live file's path) and rotation_rank: history first, the live file last.

    Numbered files rank NUMBER_BASE - n (higher numbers are older), dated ones by days since 1970, so dated history
    comes before numbered; a name that is neither, or whose date does not exist, is a live file."""
    name = F.element_at(F.split(F.col(source), "/"), -1)
    folder = F.substring(F.col(source), F.lit(1), F.length(source) - F.length(name))
    number = F.regexp_extract(name, "(?i)" + _NUMBERED, 2).try_cast("long")
    dated = F.regexp_extract(name, "(?i)" + _DATED, 2).try_cast("date")
    infix = F.regexp_extract(name, "(?i)" + _INFIX, 2).try_cast("date")
    numbered = number.between(1, NUMBER_BASE - 1)
    stem = (
        F.when(numbered, F.regexp_extract(name, "(?i)" + _NUMBERED, 1))
        .when(dated.isNotNull(), F.regexp_extract(name, "(?i)" + _DATED, 1))
        .when(infix.isNotNull(), F.concat_ws(".", F.regexp_extract(name, "(?i)" + _INFIX, 1), F.regexp_extract(name, "(?i)" + _INFIX, 3)))
        .otherwise(name)
    )
    rank = F.when(numbered, NUMBER_BASE - number).when(dated.isNotNull(), F.unix_date(dated)).when(infix.isNotNull(), F.unix_date(infix)).otherwise(F.lit(2**62))
    return df.withColumn("rotation_family", F.concat(folder, stem)).withColumn("rotation_rank", rank.cast("long"))


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all frames in order (source_rank), columns united; a source and line that comes twice is kept once."""
    out = frames[0].withColumn("source_rank", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("source_rank", F.lit(i)), allowMissingColumns=True)
    if {"source", "line_id"} <= set(out.columns):
        # only rows of sources that several frames have are shuffled; this table has one row a source
        several = out.groupBy("source").agg(F.min("source_rank").alias("_a"), F.max("source_rank").alias("_z")).where("_a < _z").select("source")
        least = Window.partitionBy("source", "line_id").orderBy("source_rank")
        again = out.join(several, "source", "left_semi").withColumn("_k", F.row_number().over(least)).where("_k = 1").drop("_k")
        out = out.join(several, "source", "left_anti").unionByName(again)
    return out
