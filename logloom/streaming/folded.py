"""Records of several lines on a stream, folded by the batch's blocks: one hot source is many tasks.

A batch's lines go together with those of the records that were still open. Headers are counted block by block (sources.folding), so
that neither a source nor a batch is one task: records that lie whole in a block are joined where the block is, and only lines at
the blocks' edges meet those of other blocks. What is kept between batches is only each source's open record, or the bounds of its
open run of orphaned lines. Records and errors are those of the batch fold, whatever the batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import blank
from logloom.sources import folding
from logloom.streaming.stream import PENDING_MS, Merged

STATE = "source string, line_id bigint, raw string, upto bigint, seen bigint"
HEARTBEAT = "heartbeat"


def with_heartbeat(lines: DataFrame) -> DataFrame:
    """The stream of lines (source, line_id, raw) and a tick a second, a row of null line, so that a silence is noticed without new lines."""
    ticks = lines.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    empty = ticks.select(F.lit(HEARTBEAT).alias("source"), F.lit(None).cast("long").alias("line_id"), F.lit(None).cast("string").alias("raw"))
    return lines.select("source", F.col("line_id").cast("long").alias("line_id"), "raw").unionByName(empty)


class Folded(Merged):
    """A sink for lines (source, line_id, raw) that hands records (source, line_id, raw, error) to the next sink.

    A record is closed by its source's next header, or by a batch that comes pending_ms after its source's last line; with
    with_heartbeat() there is such a batch in every second. Its trailing blank lines go. Lines before a source's first header, or after
    a silence, are errors: a row a run of lines, without raw. Rows of null line_id or raw are skipped. line_id numbers the lines of a
    source one by one (growing.Numbered); a batch holds only lines after those of earlier batches. The next sink must replace a batch
    that runs again, as appending() does."""

    def __init__(self, spark: SparkSession, path: str, is_header: Callable[[Column], Column], sink: Callable[[DataFrame, int], None], pending_ms: int = PENDING_MS, block: int = folding.BLOCK, clock: Callable[[], float] = time.time):
        super().__init__(spark, path, lambda now, batch: now)
        self.is_header, self.sink, self.pending_ms, self.block, self.clock = is_header, sink, pending_ms, block, clock

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = int(self.clock() * 1000)
        state = self.before(number)
        if state is None:
            state = self.spark.createDataFrame([], STATE)
        lines = batch.where("line_id IS NOT NULL AND raw IS NOT NULL").select("source", "line_id", "raw", F.lit(now).cast("long").alias("seen"))
        rows = state.where("raw IS NOT NULL").select("source", "line_id", "raw", "seen").unionByName(lines)
        head = self.is_header(F.col("raw")) & ~blank(F.col("raw"))
        told = folding.count_in_blocks(rows, head, block=self.block).persist()
        # one row a block; the first use of the lines
        blocks = told.groupBy("source", "_block").agg(F.max("_all").alias("_all"), F.max("line_id").alias("_line"), F.max("seen").alias("_seen")).persist()
        runs = state.where("raw IS NULL")
        out, kept = self._parted(told, blocks, runs, now - self.pending_ms)
        self.sink(out, number)
        self.keep(kept, number)
        blocks.unpersist()
        told.unpersist()

    def _parted(self, told: DataFrame, blocks: DataFrame, runs: DataFrame, silent: int) -> tuple[DataFrame, DataFrame]:
        """Closed records and errors, and what stays open."""
        ends = blocks.groupBy("source").agg(F.sum("_all").alias("_record"), F.max("_line").alias("_line"), F.max("_seen").alias("_seen"))
        of_source = Window.partitionBy("source")
        before = of_source.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = blocks.select(F.col("source").alias("_by"), F.col("_block").alias("_b"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"), F.sum("_all").over(of_source).alias("_record"), F.max("_seen").over(of_source).alias("_seen"))
        # lines are joined by block, never by source: a hot source would be one task
        edges = told.where("_inner = 0 OR _inner = _all").join(starts, F.col("source").eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b"))).withColumn("record_id", F.col("_before") + F.col("_inner")).drop("_by", "_b", "_before", "_inner", "_block", "_all")
        begun = edges.where("record_id > 0")
        opened = (F.col("record_id") == F.col("_record")) & (F.col("_seen") > silent)
        # a source's last record is at an edge, so those that are not are closed
        records = folding.join_records(told.where("_inner > 0 AND _inner < _all"), "_block", "_inner").unionByName(folding.join_records(begun.where(~opened)))
        new = folding.orphan_runs(edges, self.block)
        # by line as well as by source: there may be many runs of one source
        grown = new.join(runs.select("source", (F.col("upto") + 1).alias("first"), F.col("line_id").alias("_first")), ["source", "first"], "left").select("source", F.coalesce("_first", "first").alias("first"), "last")
        # a run of the state that no run of the batch continues stays as it is
        alone = runs.join(new.select("source", (F.col("first") - 1).alias("upto")), ["source", "upto"], "left_anti").select("source", F.col("line_id").alias("first"), F.col("upto").alias("last"), "seen")
        # _seen where no line of the source follows the run
        at_end = (F.coalesce("_record", F.lit(0)) == 0) & (F.coalesce("_line", "last") == F.col("last"))
        every = grown.join(ends.where("_record = 0").select("source", F.col("_line").alias("last"), "_seen"), ["source", "last"], "left").select("source", "first", "last", "_seen").unionByName(
            alone.join(ends.drop("_seen"), "source", "left").select("source", "first", "last", F.when(at_end, F.col("seen")).alias("_seen"))
        )
        open_run = F.coalesce(F.col("_seen") > silent, F.lit(False))
        errors = folding.orphan_errors(every.where(~open_run)).select("source", F.col("first").alias("line_id"), F.lit(None).cast("string").alias("raw"), "error")
        out = records.withColumn("error", F.lit(None).cast("string")).unionByName(errors)
        kept = begun.where(opened).select("source", "line_id", "raw", F.lit(None).cast("long").alias("upto"), F.col("_seen").alias("seen"))
        kept_runs = every.where(open_run).select("source", F.col("first").alias("line_id"), F.lit(None).cast("string").alias("raw"), F.col("last").alias("upto"), F.col("_seen").alias("seen"))
        return out, kept.unionByName(kept_runs)

    def pending(self) -> DataFrame:
        """What is open now, as records and errors: the last rows of a stream that has ended."""
        state = self.table()
        records = folding.join_records(state.where("raw IS NOT NULL").withColumn("record_id", F.lit(1)))
        runs = state.where("raw IS NULL").select("source", F.col("line_id").alias("first"), F.col("upto").alias("last"))
        errors = folding.orphan_errors(runs).select("source", F.col("first").alias("line_id"), F.lit(None).cast("string").alias("raw"), "error")
        return records.withColumn("error", F.lit(None).cast("string")).unionByName(errors)
