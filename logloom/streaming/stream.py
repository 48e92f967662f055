"""Live logs by Structured Streaming. Parsers, filters and highlights are the batch ones: they are stateless expressions.

State is kept where it must be: in tables that each batch merges into (retention, profile, order, histogram), or per source
in applyInPandasWithState (a record whose next lines have not come yet).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.functions import levels
from logloom.functions.scratch import exists, folders, remove, scratch
from logloom.functions.text import blank
from logloom.operators import histogram, schema
from logloom.sources.detect import PROBED

RETAIN, RETAIN_RANGE, ERRORS_SHOWN, PENDING_MS = 10_000, (1_000, 1_000_000), 1_000, 500


def tail_files(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """source, raw of new files in a folder. Spark reads each file once; sources.growing follows files that grow."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).option("lineSep", "\n").text(folder).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "\r\\z", "").alias("raw"))


def kafka_lines(spark: SparkSession, servers: str, topics: str, offsets_a_batch: int = 1_000_000) -> DataFrame:
    """Lines that clients send by way of Kafka; the topic and partition stand for the source."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", offsets_a_batch).load()
    return raw.select(F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("source"), F.col("offset").alias("line_id"), F.col("value").cast("string").alias("raw"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """One TCP source, for trials."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.lit(f"{host}:{port}").alias("source"), F.col("value").alias("raw"))


class Merged:
    """A table that every batch is merged into: each batch writes a new version, and the table is the last one.

    The version before is kept: a batch that is run again after a failure starts from it and replaces its own version, so
    each batch counts once. Older versions are deleted. Which versions there are is read from the folder, so a new driver that
    goes on from the stream's checkpoint, with the same path, goes on from the table too."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
        self.spark, self.path, self.merge = spark, path, merge

    def versions(self) -> list[int]:
        """Numbers of the batches whose versions are there and whole, oldest first."""
        names = [n[1:] for n in folders(self.spark, self.path) if n[1:].isdigit()]
        return sorted(int(n) for n in names if exists(self.spark, f"{self.path}/v{n}/_SUCCESS"))

    def before(self, number: int) -> DataFrame | None:
        """The table as it was before a batch."""
        earlier = [v for v in self.versions() if v < number]
        return self.spark.read.parquet(f"{self.path}/v{earlier[-1]}") if earlier else None

    def keep(self, table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for v in [v for v in self.versions() if v < number][:-1]:
            remove(self.spark, f"{self.path}/v{v}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.keep(self.merge(self.before(number), batch), number)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")


def appending(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that only adds rows: each batch has a folder of its own, which a batch that is run again replaces."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an appending sink."""
    return spark.read.parquet(path).drop("batch")


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """trigger: as DataStreamWriter.trigger() takes it; none is batch after batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(**trigger) if trigger else writer).start()


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", timers: bool = False) -> None:
    """Run a stream over all that is there now, in batches; with timers (fold_stream) in one batch, as they would go on for ever."""
    trigger = {"once": True} if timers else {"availableNow": True}
    start(stream, sink, scratch(stream.sparkSession, "stream"), mode, **trigger).awaitTermination()


def stream_histogram(stream: DataFrame, ts: str, level: str, seconds: int, mapping: dict[str, str] | None = None, watermark: str | None = None) -> DataFrame:
    """Time by level counts, updated as rows come, in any order. A watermark bounds the state and drops what is later than it."""
    rows = stream.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    return rows.groupBy(F.window(ts, f"{seconds} seconds")).agg(*histogram.level_counts(levels.level_rank(F.col(level), mapping))).select(F.col("window.start").alias("bucket_start"), *histogram.SLOTS, "total")


def merge_buckets(now: DataFrame | None, batch: DataFrame) -> DataFrame:
    """For update mode: a bucket's newer counts take the place of its older ones."""
    if now is None:
        return batch
    return now.join(batch.select("bucket_start"), "bucket_start", "left_anti").unionByName(batch)


def retain_last(n: int = RETAIN, row_id: str = "row_id", by: str | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge that keeps the newest n rows, of all or of each `by`."""
    n = max(RETAIN_RANGE[0], min(RETAIN_RANGE[1], n))

    def merge(now: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if now is None else now.unionByName(batch, allowMissingColumns=True)
        if by is None:
            return both.orderBy(F.col(row_id).desc()).limit(n)
        newest = Window.partitionBy(by).orderBy(F.col(row_id).desc())
        return both.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")

    return merge


def drop_evicted(anchors: DataFrame, retained: DataFrame) -> DataFrame:
    """Anchors of rows that are still there."""
    return anchors.join(retained.select("source", "line_id"), ["source", "line_id"], "left_semi")


def recent_errors(n: int = ERRORS_SHOWN) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge that keeps the newest n error rows of parsed batches (column row_id)."""

    def merge(now: DataFrame | None, batch: DataFrame) -> DataFrame:
        bad = batch.where(F.col("error").isNotNull())
        return (bad if now is None else now.unionByName(bad)).orderBy(F.col("row_id").desc()).limit(n)

    return merge


def merge_profile(now: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Profile of parsed rows, merged: the same as of all rows at once, whatever the batches. schema.promote() types the table, and
    new keys appear as they come."""
    new = schema.profile(batch)
    return new if now is None else schema.merged_profiles(now.unionByName(new))


def merge_order(ts: str, row_id: str, by: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge that keeps, for each source, its last time and whether times have never fallen."""

    def merge(now: DataFrame | None, batch: DataFrame) -> DataFrame:
        own = schema.is_monotonic(batch, ts, row_id, by)
        new = batch.groupBy(by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).join(own, by, "left").withColumn("monotonic", F.coalesce("monotonic", F.lit(True)))
        if now is None:
            return new.select(by, "last_ts", "monotonic")
        old = now.select(by, F.col("last_ts").alias("old_ts"), F.col("monotonic").alias("was"))
        return new.join(old, by, "full").select(by, F.greatest("last_ts", "old_ts").alias("last_ts"), (F.coalesce("was", F.lit(True)) & F.coalesce("monotonic", F.lit(True)) & ~F.coalesce(F.col("first_ts") < F.col("old_ts"), F.lit(False))).alias("monotonic"))

    return merge


def detect_then_parse(parse: dict[str, Callable[[DataFrame], DataFrame]], detect: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for lines (source, line_id, raw) whose formats are told by each source's first lines that are not blank, wherever
    their numbers start, and then kept; JSON where nothing is told. A CSV source keeps its first line as header over all batches.
    path: a shared folder that keeps both over restarts."""
    known: dict[str, tuple[str, int | None, str | None]] = {}
    columns = "source string, format string, line_id bigint, header string"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if path and not known and exists(spark, path):
            known.update({r["source"]: (r["format"], r["line_id"], r["header"]) for r in spark.read.schema(columns).parquet(path).collect()})  # one row a source
        new = batch.where(~F.col("source").isin(list(known))) if known else batch
        place = F.row_number().over(Window.partitionBy("source").orderBy("line_id"))
        first = new.where(~blank(F.col("raw"))).select("source", "raw", F.col("line_id").alias("_id"), place.cast("long").alias("line_id")).where(F.col("line_id") <= PROBED).withColumn("line_id", F.col("line_id") - 1)
        told = {r["source"]: r["format"] for r in detect(first.drop("_id")).collect()}  # one row a source
        rows = []
        for r in first.where("line_id = 0").collect():  # one row a source
            f = told.get(r["source"], "json")
            rows.append((r["source"], f if f in parse else "json", *((r["_id"], r["raw"]) if f == "csv" else (None, None))))
        if rows and path:
            spark.createDataFrame(rows, columns).write.mode("append").parquet(path)
        known.update({r[0]: r[1:] for r in rows})
        parts = []
        for f in sorted({k[0] for k in known.values()}):
            own = batch.where(F.col("source").isin([s for s, k in known.items() if k[0] == f]))
            if f == "csv":  # the header goes before all lines of the batch; where it is one of them it is not repeated
                heads = spark.createDataFrame([(s, *k[1:]) for s, k in known.items() if k[0] == f], "source string, line_id bigint, raw string")
                own = own.join(heads, ["source", "line_id", "raw"], "left_anti").unionByName(heads.withColumn("line_id", F.lit(-(2**63)).cast("long")), allowMissingColumns=True)
            parts.append(parse[f](own))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        if out is not None:
            sink(out, number)

    return run


def fold_stream(lines: DataFrame, header_pattern: str, pending_ms: int = PENDING_MS) -> DataFrame:
    """Records of lines (source, line_id, raw). A record comes out once its source's next header does, or after a silence of
    pending_ms, without its trailing blank lines either way. A run of lines before a source's first header, but for blank ones, is
    an error: its row has no raw but an error. The lines of one source and batch are folded in one task."""
    import re

    head = re.compile(header_pattern)

    def without_blank_end(text: str) -> str:
        first, *rest = text.split("\n")
        while rest and not rest[-1].strip():
            rest.pop()
        return "\n".join((first, *rest))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = [state.get[0], [state.get[1]]] if state.exists else [None, []]
        out: list[tuple] = []
        lost: list[int] = []

        def close() -> None:
            if pending[0] is not None:
                out.append((key[0], pending[0], without_blank_end("\n".join(pending[1])), None))

        def report() -> None:
            if lost:
                where = f"line {lost[0] + 1}" if len(lost) == 1 else f"lines {lost[0] + 1}-{lost[-1] + 1}"
                out.append((key[0], lost[0], None, f"Error on {where}: {len(lost)} orphaned continuation line(s)"))
                lost.clear()

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("line_id")
            for line_id, raw in zip(rows["line_id"].tolist(), rows["raw"].tolist(), strict=True):
                if head.match(raw):
                    report()
                    close()
                    pending = [line_id, [raw]]
                elif pending[0] is not None:
                    pending[1].append(raw)
                elif raw.strip():
                    if lost and line_id != lost[-1] + 1:
                        report()
                    lost.append(line_id)
            report()
            if pending[0] is not None:
                state.update((int(pending[0]), "\n".join(pending[1])))
                state.setTimeoutDuration(pending_ms)
        yield pd.DataFrame(out, columns=["source", "line_id", "raw", "error"])

    return lines.groupBy("source").applyInPandasWithState(fold, "source string, line_id bigint, raw string, error string", "line_id bigint, raw string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def history_then_live(history: DataFrame, live: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write rotated history, then append the live stream to the same table; appended() reads both. A restart with the same
    checkpoint goes on with the stream only."""
    spark = history.sparkSession
    if not exists(spark, f"{path}/batch=-1/_SUCCESS"):
        history.write.mode("overwrite").parquet(f"{path}/batch=-1")
    return start(live, appending(path), checkpoint, **trigger)
