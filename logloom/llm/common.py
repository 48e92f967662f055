"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a character class body that Java, DuckDB and Python read alike.
BLANKS = r"\x20\x09-\x0D"
#: Cells of a range lookup table; its size does not depend on the data.
CELLS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and Spark is local (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = os.environ.get("LOGLOOM_SHARED") or tempfile.mkdtemp(prefix="logloom-", dir="/tmp")
        os.environ["LOGLOOM_SHARED"] = set_to
    return set_to


_made: list[list[DataFrame]] = []


def materialise(df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _made and not lasting:
        _made[-1].append(table)
    return table


@contextlib.contextmanager
def temporaries() -> Iterator[None]:
    """Tables materialised inside, but for lasting ones, are deleted at the end: nothing that is used later may read them."""
    _made.append([])
    try:
        yield
    finally:
        release(*_made.pop())


def release(*frames: DataFrame) -> None:
    """Delete the folders that materialise() wrote for these frames, by Hadoop's file system API."""
    for df in frames:
        with contextlib.suppress(Exception):
            jvm = df.sparkSession._jvm
            for f in df.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(f).getParent()
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numeric(docs: DataFrame, column: str) -> None:
    """ValueError unless the column's type is a whole number."""
    if not isinstance(docs.schema[column].dataType, T.IntegralType):
        raise ValueError(f"{column} must be a whole number, not {docs.schema[column].dataType.simpleString()}")


def kept(names: tuple[str, ...], own: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Columns that go through an operator under names that nothing inside has, and what they come out as. ValueError where one
    is named as a column of the result."""
    if clash := set(names) & set(own):
        raise ValueError(f"columns of the result can't be kept as well: {sorted(clash)}")
    return [F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(names)], [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(names)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def range_bin(key: Column, splitters: list[int]) -> Column:
    """Number of splitters <= key (null key: 0), by a lookup table of CELLS entries and a short scan.

    The splitters must be sorted. A native expression; its cost per row follows the splitters of one cell,
    not their number.
    """
    if not splitters:
        return F.lit(0)
    low, high = splitters[0], splitters[-1]
    width = max(1, math.ceil((high - low + 1) / CELLS))
    cells: list[list[int]] = [[] for _ in range((high - low) // width + 1)]
    for s in splitters:
        cells[(s - low) // width].append(s)
    base, bases = 0, []
    for c in cells:
        bases.append(base)
        base += len(c)
    at = F.floor((key - F.lit(low)) / F.lit(width)).cast("int")
    lists = F.from_json(F.lit(json.dumps(cells)), "array<array<bigint>>")  # constants: folded once
    starts = F.from_json(F.lit(json.dumps(bases)), "array<int>")
    inside = F.element_at(starts, at + 1) + F.size(F.filter(F.element_at(lists, at + 1), lambda s: s <= key))
    return F.when(key.isNull() | (key < low), 0).when(key > high, len(splitters)).otherwise(inside).cast("int")
