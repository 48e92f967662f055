"""Streams whose state is more than a row a key: folded records, sorted views, histograms that rows leave again."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.scratch import scratch
from logloom.operators import histogram, sorting
from logloom.sources import folding
from logloom.streaming import folded, runs, stream


class Clock:
    now = 1_000.0

    def __call__(self):
        return self.now


def fold(spark, batches, clock=None, waits=(), pending_ms=3_600_000, block=4):
    out = scratch(spark, "records")
    clock = clock or Clock()
    sink = folded.Folded(spark, scratch(spark, "open"), folding.indented_header, stream.appending(out), pending_ms, block, clock)
    for i, rows in enumerate(batches):
        clock.now += waits[i] if waits else 0
        sink(spark.createDataFrame(rows, "source string, line_id long, raw string"), i)
    return sink, lambda df: sorted(((r["source"], r["line_id"], r["raw"], r["error"]) for r in df.collect()), key=str), out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_whatever_the_batches(spark, seed):
    """Any cut of two sources, one of 90 % of the lines, into batches: the records and errors of the batch fold."""
    rng = random.Random(seed)
    texts = [("hot" if rng.random() < 0.9 else "cold", rng.choice(["h", " c", " c", "", " ", "h x"])) for _ in range(60)]
    texts[:4] = [("hot", " lost"), ("hot", " too"), ("hot", ""), ("hot", " lost again")]
    count, rows = {}, []
    for source, text in texts:
        rows.append((source, count.get(source, 0), text))
        count[source] = count.get(source, 0) + 1
    cuts = sorted(rng.sample(range(1, 60), 3)) if seed > 1 else [1, 2, 3]
    sink, plain, out = fold(spark, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 60])])
    every = spark.createDataFrame(rows, "source string, line_id long, raw string")
    head = folding.indented_header(F.col("raw"))
    batch = folding.fold_lines(every, head).withColumn("error", F.lit(None).cast("string"))
    lost = folding.orphans(every, head).select("source", F.col("first").alias("line_id"), F.lit(None).cast("string").alias("raw"), "error")
    assert plain(stream.appended(spark, out).unionByName(sink.pending())) == plain(batch.unionByName(lost))


def test_fold_silence_and_repeat(spark):
    """A source that is silent is closed, others stay open; a batch that runs again counts once; null lines are skipped."""
    batches = [[("a", 0, "h1"), ("b", 0, "h"), ("c", 0, " lost")], [("b", 1, " c"), ("x", None, None)], [("b", 2, ""), ("x", None, None)], [("a", 1, " late"), ("a", 2, "h2")]]
    clock = Clock()
    sink, plain, out = fold(spark, batches, clock, (0, 0.4, 0.4, 0.1), 500)
    assert plain(stream.appended(spark, out)) == [("a", 0, "h1", None), ("a", 1, None, "Error on line 2: 1 orphaned continuation line(s)"), ("c", 0, None, "Error on line 1: 1 orphaned continuation line(s)")]
    once = plain(sink.pending())
    assert once == [("a", 2, "h2", None), ("b", 0, "h\n c", None)]
    sink(spark.createDataFrame(batches[3], "source string, line_id long, raw string"), 3)
    assert plain(sink.pending()) == once and len(plain(stream.appended(spark, out))) == 3
    empty, _, none = fold(spark, [[], []])
    assert empty.pending().count() == 0 and stream.appended(spark, none).count() == 0


@pytest.mark.parametrize("text", ["h", " lost"])
def test_fold_hot_source_is_many_tasks(spark, text):
    """Records and errors of one source come out of several tasks, none of which has most of them, with no help of broadcasts."""
    told = {}

    def sink(df, n):
        told[n] = {r["task"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()}

    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        fold = folded.Folded(spark, scratch(spark, "open"), folding.indented_header, sink, 3_600_000, 20, Clock())
        raw = F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.lit(""))
        fold(spark.range(4_000).select(F.lit("hot").alias("source"), F.col("id").alias("line_id"), raw.alias("raw")), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(told[0].values()) in (1_999, 2_000) and max(told[0].values()) < 1_200


def test_fold_heartbeat(spark, tmp_path):
    """With a heartbeat the last record comes without another line."""
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("0:h1\n1: c1\n")
    lines = stream.tail_files(spark, str(tmp_path / "in")).select("source", F.split("raw", ":")[0].cast("long").alias("line_id"), F.split("raw", ":")[1].alias("raw"))
    got = []
    sink = folded.Folded(spark, scratch(spark, "open"), folding.indented_header, lambda df, n: got.extend(r["raw"] for r in df.collect()), 300)
    query = stream.start(folded.with_heartbeat(lines), sink, scratch(spark, "stream"), processingTime="500 milliseconds")
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert got == ["h1\n c1"]


@pytest.mark.parametrize("descending", [False, True])
def test_sorted_view(spark, descending):
    """Pages of a view that many batches were inserted into, with ties and nulls; a page reads few files; files that no version names go."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(40)])) for i in range(600)]
    rng.shuffle(rows)
    view = runs.SortedRuns(spark, scratch(spark, "view"), "v", descending, block=20, runs=3)
    for k in range(6):
        view(spark.createDataFrame(rows[100 * k : 100 * k + 100], "row_id long, v long"), k)
    view(spark.createDataFrame(rows[500:], "row_id long, v long"), 5)  # once more
    whole = [r["row_id"] for r in sorting.sort_logs(spark.createDataFrame(rows, "row_id long, v long"), "v", descending).collect()]
    for a, b in ((0, 30), (285, 310), (590, 700), (10, 10), (700, 710)):
        assert [r["row_id"] for r in view.page(a, b).collect()] == whole[a:b]
    fences = view.table()
    some, before = view.overlapping(fences, 300, 310)
    assert fences.where(F.col("file").isin(some)).agg(F.sum("rows")).first()[0] <= 120 and before > 0 and fences.agg(F.sum("rows")).first()[0] == 600
    assert fences.select("run").distinct().count() <= 4
    empty = runs.SortedRuns(spark, scratch(spark, "view"), "v")
    empty(spark.createDataFrame([], "row_id long, v long"), 0)
    assert empty.page(0, 10).count() == 0


def test_histogram_with_retraction(spark):
    """After each batch the buckets are those of a recount; late rows, empty batches and batches that run again too."""
    rng = random.Random(5)
    sink = runs.RetainedHistogram(spark, scratch(spark, "kept"), "ts", "level", 3600, 1000, block=100, runs=2)
    seen, at = [], 0

    def frame(rows):
        return spark.createDataFrame(rows, "row_id long, t long, level string").select("row_id", F.timestamp_seconds("t").alias("ts"), "level")

    def check():
        kept = sorted(seen, key=lambda r: -r[0])[:1000]
        assert {r["row_id"] for r in sink.kept().collect()} == {r[0] for r in kept}
        plain = lambda h: sorted(tuple(r[c] for c in ("bucket_start", *histogram.SLOTS, "total")) for r in h.collect())
        assert plain(sink.histogram()) == plain(histogram.histogram(frame(kept), "ts", "level", 3600))

    sizes = [700, 250, 400, 0, 900, 150]
    for k, n in enumerate(sizes):
        rows = [(at + i, (at + i) * 60 + rng.randrange(-4000, 4000), rng.choice(["error", "info", "odd", None])) for i in range(n)]
        rows = [(r, None if r % 50 == 0 else t, level) for r, t, level in rows]
        if k == 2:  # ids of no batch so far, between others
            rows = [(r + 10_000, t, level) for r, t, level in rows[:100]] + rows[200:]
        if k == 4:
            rows.append((-5, 0, "error"))  # late
        at += n
        seen += [r for r in rows if r[0] >= 0]
        sink(frame(rows), k)
        if k in (2, 5):
            sink(frame(rows), k)
        check()


def test_rows_that_their_own_batch_pushes_out_are_not_written(spark):
    sink = runs.RetainedHistogram(spark, scratch(spark, "kept"), "ts", "level", 3600, 1000, block=100)
    ids = F.when(F.col("id") < 4000, F.col("id")).otherwise(F.col("id") + 10**12)  # dense ranges far apart
    batch = spark.range(5_500).select(ids.alias("row_id"), F.timestamp_seconds("id").alias("ts"), F.lit("info").alias("level"))
    sink(batch, 0)
    assert spark.read.parquet(f"{sink.path}/run-0").count() <= 2000
    sink(batch.where("row_id < 100").withColumn("row_id", F.col("row_id") + 4000), 1)  # late
    assert {r["row_id"] for r in sink.kept().collect()} == {10**12 + i for i in range(4500, 5500)}
    assert sink.histogram().agg(F.sum("total")).first()[0] == 1000
