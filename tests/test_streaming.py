"""Streams in several batches: the same rows as in one, whatever the batches."""

import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import schema
from logloom.sources import detect, formats, growing
from logloom.streaming import stream


@pytest.fixture
def folder(tmp_path):
    """Three files that come one a batch."""
    path = tmp_path / "in"
    path.mkdir()
    for i in range(3):
        (path / f"{i}.log").write_text("".join(f'{{"n": {100 * i + j}, "k{i}": "x{j % 2}"}}\n' for j in range(100)) + "broken\n")
        time.sleep(0.02)
    return str(path)


def tail(spark, folder):
    """Lines with a number of their own, one file a batch."""
    lines = stream.tail_files(spark, folder, 1)
    return lines.withColumn("row_id", F.coalesce(F.get_json_object("raw", "$.n").cast("long"), F.lit(-1))).withColumn("line_id", F.col("row_id"))


def run(spark, source, merge, mode="append"):
    sink = stream.Merged(spark, stream.scratch(spark, "test"), merge)
    stream.drain(source, sink, mode)
    return sink


def test_retention(spark, folder):
    sink = run(spark, tail(spark, folder).select("row_id", "source"), stream.retain_last(5))
    assert sink.versions()[-1] == 2 and sink.table().count() == 303  # the least that is retained is 1000
    again = sink.table().count()
    sink(sink.table().limit(0), 2)  # the same batch once more counts once
    assert sink.table().count() <= again


def test_profile_and_new_keys(spark, folder):
    sink = run(spark, formats.parse_jsonl(tail(spark, folder)), stream.merge_profile)
    got = {r["key"]: (r["rows"], r["type"]) for r in schema.promote(sink.table()).collect()}
    assert got == {"n": (300, "integer"), "k0": (100, "enum"), "k1": (100, "enum"), "k2": (100, "enum")}


def test_errors(spark, folder):
    parsed = formats.parse_jsonl(tail(spark, folder)).select("row_id", "error")
    assert run(spark, parsed, stream.recent_errors(2)).table().count() == 2


def test_order_over_batches(spark, folder):
    rows = tail(spark, folder).where("row_id >= 0").select(F.lit("s").alias("source"), "row_id", F.timestamp_seconds("row_id").alias("ts"))
    assert run(spark, rows, stream.merge_order("ts", "row_id", "source")).table().first()["monotonic"]
    back = rows.withColumn("ts", F.timestamp_seconds(F.when(F.col("row_id") == 250, 0).otherwise(F.col("row_id"))))
    assert not run(spark, back, stream.merge_order("ts", "row_id", "source")).table().first()["monotonic"]


def test_detection_on_a_stream(spark, folder):
    seen = []
    sink = stream.detect_then_parse({"json": formats.parse_jsonl}, detect.detect_formats, lambda df, n: seen.append(df.where("fields IS NOT NULL").count()))
    lines = tail(spark, folder).select("source", "line_id", "raw").where("line_id >= 0").withColumn("line_id", F.col("line_id") % 100)
    stream.drain(lines, sink)
    assert sum(seen) == 300


def test_csv_over_batches_and_late_offsets(spark, tmp_path):
    """A header holds for later batches, after a restart too, and numbers may start anywhere."""
    seen = []

    def sink():
        return stream.detect_then_parse({"json": formats.parse_jsonl, "csv": formats.parse_csv}, detect.detect_formats, lambda df, n: seen.extend((r["source"], dict(r["fields"])) for r in df.collect()), str(tmp_path / "known"))

    def batch(*rows):
        return spark.createDataFrame(rows, "source string, line_id long, raw string")

    one = sink()
    one(batch(("c", 1000, "a,b"), ("c", 1001, "1,2"), ("j", 500, '{"n": 1}')), 0)
    one(batch(("c", 1002, "3,4"), ("c", 1003, "5,6"), ("j", 501, '{"n": 2}')), 1)
    sink()(batch(("c", 1004, "7,8")), 2)
    cells = [("c", {"a": a, "b": b}) for a, b in ("12", "34", "56", "78")]
    assert sorted(seen, key=str) == sorted([*cells, ("j", {"n": "1"}), ("j", {"n": "2"})], key=str)


def test_table_goes_on_after_a_restart(spark, folder, tmp_path):
    """A new driver with the same checkpoint and path: nothing is lost, and a batch that is run again counts once."""
    checkpoint, path = str(tmp_path / "checkpoint"), str(tmp_path / "table")
    rows = stream.tail_files(spark, folder, 1).select("source", F.get_json_object("raw", "$.n").cast("long").alias("row_id")).where("row_id IS NOT NULL")
    merge = stream.retain_last(1000)
    first = stream.start(rows, stream.Merged(spark, path, merge), checkpoint, availableNow=True)
    first.awaitTermination()
    (tmp_path / "in" / "3.log").write_text("".join(f'{{"n": {1000 + j}}}\n' for j in range(50)))
    again = stream.Merged(spark, path, merge)
    stream.start(rows, again, checkpoint, availableNow=True).awaitTermination()
    assert {r["row_id"] for r in again.table().collect()} == {*range(300), *range(1000, 1050)}
    last = again.versions()[-1]
    again(spark.createDataFrame([("x", 5000)], "source string, row_id long"), last)  # batch `last` anew, with other rows
    assert {r["row_id"] for r in again.table().collect()} == {*range(300), 5000}
    assert len(again.versions()) == 2


def test_growing_files(spark, tmp_path):
    """Lines come once, when they are finished, over restarts; small splits cut inside lines; a file that is cut starts anew."""
    path, got = tmp_path / "a.log", []

    def go():
        lines_ = growing.follow(spark, str(tmp_path / "*.log"), split=5)
        stream.start(lines_, lambda df, n: got.append(sorted((r["line_id"], r["raw"]) for r in df.collect())), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    path.write_text("\ufeffone\ntwo and more\nthr")
    go()
    with path.open("ab") as f:
        f.write(b"ee\nfour\r\n\n")
    (tmp_path / "b.log").write_text("x\n")
    go()
    go()
    path.write_text("new\n")
    go()
    assert got == [[(0, "one"), (7, "two and more")], [(0, "x"), (20, "three"), (26, "four"), (32, "")], [(0, "new")]]


def test_appending_sink_replaces_a_batch_that_runs_again(spark, tmp_path):
    sink = stream.appending(str(tmp_path / "rows"))
    for number, rows in ((0, [1, 2]), (1, [3]), (1, [4, 5])):
        sink(spark.createDataFrame([(r,) for r in rows], "n long"), number)
    assert sorted(r["n"] for r in stream.appended(spark, str(tmp_path / "rows")).collect()) == [1, 2, 4, 5]


def test_blank_ends_and_orphans_of_a_folded_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines_ = [" lost", " too", "", "h1", " c1", "", "h2", "", " c2", "", ""]
    (tmp_path / "in" / "a.log").write_text("".join(f"{i}:{t}\n" for i, t in enumerate(lines_)))
    split = stream.tail_files(spark, str(tmp_path / "in")).select("source", F.split("raw", ":")[0].cast("long").alias("line_id"), F.split("raw", ":")[1].alias("raw"))
    got = []
    query = stream.start(stream.fold_stream(split, r"\S", 300), lambda df, n: got.extend((r["line_id"], r["raw"], r["error"]) for r in df.collect()), stream.scratch(spark, "test"), processingTime="200 milliseconds")
    end = time.time() + 60
    while len(got) < 3 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert got == [(0, None, "Error on lines 1-2: 2 orphaned continuation line(s)"), (3, "h1\n c1", None), (6, "h2\n\n c2", None)]


def test_pending_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("h1\n c1\nh2\n c2\n")
    lines = stream.tail_files(spark, str(tmp_path / "in")).withColumn("line_id", F.expr("CASE raw WHEN 'h1' THEN 0 WHEN ' c1' THEN 1 WHEN 'h2' THEN 2 ELSE 3 END").cast("long"))
    got = []
    query = stream.start(stream.fold_stream(lines.select("source", "line_id", "raw"), r"\S", 300), lambda df, n: got.extend(r["raw"] for r in df.collect()), stream.scratch(spark, "test"), processingTime="200 milliseconds")
    end = time.time() + 60
    while len(got) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert got == ["h1\n c1", "h2\n c2"]


class Tail:
    """A followed folder: go() runs a batch (in a stream of its own each time: a restart), got are its rows."""

    def __init__(self, spark, folder, pattern, **options):
        self.spark, self.folder, self.pattern, self.options = spark, folder, pattern, options
        self.got = []

    def go(self):
        before = len(self.got)
        sink = growing.Numbered(str(self.folder / "counts"), lambda df, n: self.got.extend((r["raw"], r["line_id"]) for r in df.orderBy("file", "line_id").collect()), block=6)
        lines_ = growing.follow(self.spark, f"{self.folder}/in/{self.pattern}", split=7, **self.options)
        stream.start(lines_, sink, str(self.folder / "checkpoint"), availableNow=True).awaitTermination()
        return sorted(self.got[before:])


@pytest.mark.parametrize("pattern", ["app.log", "app.log*"])
@pytest.mark.parametrize("how", ["rename", "copy", "cut"])
def test_rotation(spark, tmp_path, pattern, how):
    """Each line once, with its number in its file, over rotations and restarts."""
    (tmp_path / "in").mkdir()
    log, old, tail_ = tmp_path / "in" / "app.log", tmp_path / "in" / "app.log.1", Tail(spark, tmp_path, pattern)
    log.write_text("a1 first\na2\n")
    assert tail_.go() == [("a1 first", 0), ("a2", 1)]
    if how == "cut":  # in place, after all was read; grown beyond the old offset
        log.write_text("b1 and more of it\nb2\n")
        assert tail_.go() == [("b1 and more of it", 0), ("b2", 1)]
    else:
        with log.open("a") as f:
            f.write("a3 late\n")  # just before it goes
        if how == "rename":
            log.rename(old)
        else:
            old.write_bytes(log.read_bytes())
            log.write_text("")
        with log.open("a") as f:
            f.write("b1 and more of it, beyond the old one\nb2\n")
        assert tail_.go() == [("a3 late", 2), ("b1 and more of it, beyond the old one", 0), ("b2", 1)]
    if how == "rename":
        with old.open("a") as f:
            f.write("a4 later still\n")
        assert tail_.go() == [("a4 later still", 3)]
    with log.open("a") as f:
        f.write("b3\nopen")
    assert tail_.go() == [("b3", 2)]
    log.unlink()
    log.write_text("c1\n")
    assert tail_.go() == [("c1", 0)] and tail_.go() == []


def test_history_up_to_an_offset(spark, tmp_path):
    """A file in both halves comes once; a limit makes several batches."""
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "app.log"
    log.write_text("".join(f"line {i}\n" for i in range(10)) + "un")
    until = growing.offsets(f"{tmp_path}/in/*.log")
    with log.open("a") as f:
        f.write("finished\n" + "".join(f"line {i}\n" for i in range(10, 40)))
    assert sorted(r["raw"] for r in growing.history(spark, until, 16).collect()) == sorted(f"line {i}" for i in range(10))
    sizes, rows = [], []

    def sink(df, n):
        found = [r["raw"] for r in df.collect()]
        sizes.append(len(found))
        rows.extend(found)

    query = stream.start(growing.follow(spark, f"{tmp_path}/in/*.log", limit=64, start=until), sink, str(tmp_path / "checkpoint"))
    end = time.time() + 60
    while len(rows) < 31 and time.time() < end:
        time.sleep(0.1)
    with log.open("a") as f:
        f.write("".join(f"line {i}\n" for i in range(40, 70)))
    while len(rows) < 61 and time.time() < end:
        time.sleep(0.1)
    query.stop()
    assert sorted(rows) == sorted(["unfinished", *(f"line {i}" for i in range(10, 70))]) and len(sizes) > 3 and max(sizes[1:]) < 10


def test_long_lines_and_files_that_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "app.log"
    log.write_text("x" * 5_000_000 + "\n" + "y\n" * 5)
    got = growing.history(spark, growing.offsets(str(log)), 1 << 20).select(F.length("raw").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [1] * 5 + [5_000_000]
    until = growing.offsets(str(log))
    log.unlink()
    assert growing.history(spark, until).count() == 0


def test_profile_whatever_the_batches(spark):
    import random

    rng = random.Random(6)
    rows = [{"few": f"v{i % 3}", "many": f"v{i}", "edge": f"e{i % 65}", "fit": f"e{i % 64}", "level": rng.choice(["info", "warn"]), "n": i} for i in range(400)]
    for r in rows[::60]:
        r["few"] = "long" * 20
    rows += [{"lone": "long" * 20}, {"lone": "s"}, {"lone": "s"}, {"none": None}]
    import json

    lines_ = [("f", i, json.dumps(r)) for i, r in enumerate(rows)]
    frame = lambda some: formats.parse_jsonl(spark.createDataFrame(some, "source string, line_id long, raw string"))
    plain = lambda p: {r["key"]: (tuple(r[c] for c in ("rows", "null", "string", "int", "long")), r["values"], r["overflow"], r["type"]) for r in schema.promote(p).collect()}
    whole = plain(schema.profile(frame(lines_)))
    assert whole["edge"][1:3] == (None, True) and len(whole["fit"][1]) == 64 and whole["lone"][0] == (3, 0, 3, 0, 1) and whole["lone"][1] == ["s"]
    for cuts in ([200], [1, 2, 399, 401], [100, 150, 400]):
        now = None
        for a, b in zip([0, *cuts], [*cuts, len(lines_)]):
            now = stream.merge_profile(now, frame(lines_[a:b]))
        assert plain(now) == whole


def test_blank_lines_of_a_folded_stream_take_no_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = ["h1", *[""] * 400, " c1", *[" "] * 400, "h2"]
    (tmp_path / "in" / "a.log").write_text("".join(f"{i}:{t}\n" for i, t in enumerate(texts)))
    split = stream.tail_files(spark, str(tmp_path / "in")).select("source", F.split("raw", ":")[0].cast("long").alias("line_id"), F.split("raw", ":")[1].alias("raw"))
    path = str(tmp_path / "out")
    stream.drain(stream.fold_stream(split, r"\S", 3_600_000), stream.appending(path), timers=True)
    assert [r["raw"] for r in stream.appended(spark, path).collect()] == ["h1" + "\n" * 401 + " c1"]


def test_batches_of_several_files(spark, tmp_path):
    """The parts of a stream come in order, a batch each, and a batch is several tasks' work even where ids leave gaps."""
    from logloom.plans import details

    ids = F.when(F.col("id") < 3, F.col("id")).otherwise(F.col("id") + 1000)
    spark.range(300).select(ids.alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream.drain(details._in_parts(spark, str(tmp_path), 3, 20), lambda b, n: seen.append((len(b.select(F.input_file_name().alias("f")).distinct().collect()), *b.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first())))
    assert [s[1:] for s in seen] == [(0, 2, 3), (None, None, 0), (1003, 1299, 297)]
    assert seen[2][0] == 5
