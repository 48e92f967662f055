"""Edge cases of functions and operators on small frames."""

import datetime
import math
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import levels, text, times
from logloom.operators import annotate, export, filters, histogram, navigate, patterns, schema, sorting


def frame(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id bigint, v {kind}")


def ids(df):
    return [r["row_id"] for r in df.collect()]


def test_levels(spark):
    df = frame(spark, ["WARN", "crit", "x", None, "", "View"], "string")
    got = [r[0] for r in df.orderBy("row_id").select(levels.level_rank(F.col("v"), {"View": "trc", "x": "nonsense"})).collect()]
    assert got == [3, 5, None, None, None, 0]
    assert sum(map(len, levels.ALIASES.values())) == 37 and len(schema.LEVEL_KEYS) == 23


def test_times(spark):
    cases = {
        "2024-01-02T03:04:05.5Z": datetime.datetime(2024, 1, 2, 3, 4, 5, 500000),
        "2024-01-02 03:04:60": datetime.datetime(2024, 1, 2, 3, 5),
        "2024-01-02 03:04:05,123": datetime.datetime(2024, 1, 2, 3, 4, 5, 123000),
        "2024-01-02T03:04:05+02:00": datetime.datetime(2024, 1, 2, 1, 4, 5),
        "10/Oct/2000:13:55:36 -0700": datetime.datetime(2000, 10, 10, 20, 55, 36),
        "Dec  5 01:02:03": datetime.datetime(2023, 12, 5, 1, 2, 3),
        "Jan 15 01:02:03": datetime.datetime(2024, 1, 15, 1, 2, 3),
        "2024-01-02T03:04:05.1234567": None,
        "2024-13-02T03:04:05": None,
        "x": None,
    }
    df = frame(spark, list(cases), "string").orderBy("row_id")
    assert [r[0] for r in df.select(times.parse_time(F.col("v"), reference=datetime.date(2024, 2, 1))).collect()] == list(cases.values())
    assert times.strftime_pattern("%d/%b/%Y at %T") == "dd/MMM/yyyy 'at' HH:mm:ss"
    with pytest.raises(ValueError):
        times.strftime_pattern("%Q")


def test_zones(spark):
    df = frame(spark, ["2024-03-31 02:30:00", "2024-10-27 02:30:00", "2024-06-01 12:00:00"], "string").orderBy("row_id")
    got = [r[0] for r in df.select(times.local_to_utc(F.col("v").cast("timestamp"), "Europe/Prague")).collect()]
    assert got == [datetime.datetime(2024, 3, 31, 1), datetime.datetime(2024, 10, 27, 0, 30), datetime.datetime(2024, 6, 1, 10)]


def test_scalars(spark):
    cases = {"42": "int", " 42": "string", "+5": "string", "1d": "string", "nan": "string", "1e3": "float", "-0": "int", "18446744073709551615": "int", "18446744073709551616": "float", "": "null", "true": "bool", "True": "string", "1e400": "string", ".5": "float"}
    df = frame(spark, list(cases), "string").orderBy("row_id")
    assert [r[0] for r in df.select(text.scalar_kind(F.col("v"))).collect()] == list(cases.values())


def test_notes(spark):
    df = frame(spark, ["  a\x01b\u2028 ", "é" * 600], "string").orderBy("row_id").select(text.sanitise_note(F.col("v")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["a b", "é" * 512]


def test_filter_nulls_and_nan(spark):
    df = frame(spark, [1.0, None, math.nan, math.inf, -5.0], "double")
    assert ids(filters.where(df, filters.number_range("v", 0)).orderBy("row_id")) == [0, 3]
    assert ids(filters.where(df, filters.negate(filters.number_range("v", 0))).orderBy("row_id")) == [1, 2, 4]
    assert ids(filters.where(df, filters.number_range("v", math.nan, 1.0)).orderBy("row_id")) == [0, 4]
    t = frame(spark, ["a", None, ""], "string")
    assert ids(filters.where(t, filters.exactly("v", "")).orderBy("row_id")) == [1, 2]
    assert ids(filters.where(t, filters.matches("v", "^$")).orderBy("row_id")) == [1, 2]
    assert ids(filters.where(t, filters.matches("v", "("))) == []
    assert ids(filters.where(t, filters.matches("v", "(?P<x>a)"))) == []  # a pattern of another engine
    assert ids(filters.where(t, filters.enum_in("v", []))) == []


def test_filter_tree(spark):
    df = frame(spark, ["a", "b"], "string")
    gone = filters.enum_in("nothing", ["x"])
    assert filters.all_of(gone, filters.negate(gone)).compile(df) is None
    assert len(ids(filters.where(df, filters.any_of(gone)))) == 2
    assert len(ids(filters.where(df, filters.any_of()))) == 2
    for bad in (lambda: filters.contains("v", ""), lambda: filters.in_list("v", []), lambda: filters.in_list("v", [1, "a"]), lambda: filters.in_range("v", None, None), lambda: filters.in_range("v", 2, 1)):
        with pytest.raises(ValueError):
            bad()


def test_wildcard(spark):
    df = frame(spark, ["a/b.log", "ab.log", "x.txt", "[a]"], "string")
    assert ids(filters.where(df, filters.wildcard("v", "a*.log")).orderBy("row_id")) == [1]
    assert ids(filters.where(df, filters.wildcard("v", "a*.log", cross_slash=True)).orderBy("row_id")) == [0, 1]
    assert ids(filters.where(df, filters.wildcard("v", "[!a].t?t")).orderBy("row_id")) == [2]


def test_sort_tail(spark):
    df = frame(spark, [2.0, None, math.nan, 1.0, 2.0, math.inf], "double")
    assert ids(sorting.sort_logs(df, "v")) == [3, 0, 4, 5, 2, 1]
    assert ids(sorting.sort_logs(df, "v", descending=True)) == [1, 2, 5, 0, 4, 3]
    e = frame(spark, ["b", "x" * 65, "a", None], "string")
    assert ids(sorting.sort_logs(e, "v", kind="enum")) == [2, 0, 1, 3]
    places = sorting.positions(df, sorting.order_by(df, "v")).orderBy("position").collect()
    assert [(r["position"], r["row_id"]) for r in places] == list(enumerate([3, 0, 4, 5, 2, 1]))
    assert ids(sorting.goto_line(df, 3)) == [2] and ids(sorting.goto_line(df, 0)) == []


def test_rungs():
    second = 1_000_000
    assert histogram.auto_rung(0, 499 * second) == 1
    assert histogram.auto_rung(0, 500 * second) == 10
    assert histogram.auto_rung(5, 5) == 1 and histogram.auto_rung(0, second, 0) == 86400
    assert histogram.auto_rung(0, 10**15) == 86400 and histogram.auto_rung(None, None) == 1


def test_histogram_before_1970(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:59.5", "INFO"), ("1970-01-01 00:00:01", None), (None, "INFO")], "t string, l string").withColumn("t", F.col("t").cast("timestamp"))
    got = histogram.histogram(df, "t", "l", 1, dense=True).orderBy("bucket_start").collect()
    assert [(r["bucket_start"].second, r["info"], r["unknown"], r["total"]) for r in got] == [(59, 1, 0, 1), (0, 0, 0, 0), (1, 0, 1, 1)]


def test_empty_frames(spark):
    df = frame(spark, [], "double")
    assert sorting.positions(df, sorting.order_by(df, "v")).count() == 0
    assert navigate.next_marked(df, "row_id", F.col("v") > 0).count() == 0
    t = df.select("row_id", F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("string").alias("l"))
    assert histogram.histogram(t, "t", "l", dense=True).count() == 0


def test_asof(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 05:00:00"), (3, "2024-01-01 05:00:00")], "row_id bigint, t string").withColumn("t", F.col("t").cast("timestamp"))
    asks = spark.createDataFrame([(1, "2023-12-31 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:01"), (4, "2024-01-02 00:00:00")], "k int, target_ts string").withColumn("target_ts", F.col("target_ts").cast("timestamp"))
    got = {r["k"]: r["found_row"] for r in navigate.asof_rows(rows, "t", asks, seconds=600).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: None}


def test_exports(spark):
    df = spark.createDataFrame([(1, 'a"b|c\n', math.nan, 2.0, None), (2, "=1", 1.5, math.inf, True)], "row_id bigint, s string, x double, y double, z boolean")
    assert [r[0] for r in export.to_json_lines(df).collect()] == ['{"row_id":1,"s":"a\\"b|c\\n","x":null,"y":2.0}', '{"row_id":2,"s":"=1","x":1.5,"y":null,"z":true}']
    assert [r[0] for r in export.to_csv_lines(df, ["s", "z"]).collect()] == ['"a""b|c",', "\"'=1\",true"]
    got = export.to_markdown_lines(df, "row_id", ["s", "z"]).orderBy("position").collect()
    assert [r["value"] for r in got] == ["| s | z |", "| --- | --- |", '| a"b\\|c |  |', "| =1 | true |"]


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("s", 3, 0, "x"), ("s", 9, 1, "y")], "source string, line_id bigint, row_id bigint, m string")
    anchors = spark.createDataFrame([("s", 9, 4, "n"), ("gone", 1, 1, None)], "source string, line_id bigint, colour int, note string")
    path = str(tmp_path / "snap")
    export.write_snapshot(rows, path, anchors)
    assert export.read_snapshot(spark, path).count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{path}/anchors").collect()] == [(1, 4, "n")]
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        export.read_snapshot(spark, path)


def test_anchors_and_find(spark):
    df = spark.createDataFrame([("s", 0, "one two"), ("s", 1, "three")], "source string, line_id bigint, m string")
    marks = annotate.replace_anchors(df.where("line_id = 1"), 99, " hi ")
    assert [(r["line_id"], r["colour"], r["note"]) for r in annotate.with_anchors(df, marks).orderBy("line_id").collect()] == [(0, None, None), (1, 7, "hi")]
    assert annotate.find(df, "t*o", "wildcard", ["m"]).count() == 1
    assert annotate.find(df, "TWO", columns=["m"], ignore_case=True).count() == 1 and annotate.find(df, "").count() == 0


def test_health_and_order(spark):
    df = spark.createDataFrame([(0, "1", "true"), (1, "x", None), (2, None, "no")], "row_id bigint, a string, b string")
    got = {r["column"]: (r["total"], r["present"], r["matching"]) for r in schema.type_health(df, {"a": "integer", "b": "boolean"}).collect()}
    assert got == {"a": (3, 2, 1), "b": (3, 2, 1)}
    t = frame(spark, [1, 2, 2, None, 3], "int")
    assert schema.is_monotonic(t, "v", "row_id", block_rows=2).first()["monotonic"]
    assert not schema.is_monotonic(frame(spark, [1, 3, 2], "int"), "v", "row_id", block_rows=2).first()["monotonic"]
    assert schema.retype(df, "a", "integer").orderBy("row_id").first()["a"] == 1


def test_navigation_is_linear_in_a_crowded_hour(spark):
    """All rows in one hour, and default blocks: frames run from the start, so each row is looked at once."""
    n = 70_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.timestamp_micros(F.col("id") * 7919 % n * 40_000).alias("ts"), (F.col("id") % 1000 == 5).alias("marked"))
    marked = navigate.next_marked(df, "row_id", F.col("marked"))
    asks = spark.range(50).select(F.col("id").alias("k"), F.timestamp_micros(F.col("id") * 72_000_000 + 1).alias("target_ts"))
    found = navigate.asof_rows(df, "ts", asks)
    for plan in (marked, found):
        text_of = plan._jdf.queryExecution().optimizedPlan().toString().lower()
        assert not re.search(r"(?:currentrow\$\(\)|\d), unboundedfollowing", text_of)
    got = marked.agg(F.sum("next_marked"), F.sum("previous_marked"), F.count(F.lit(1))).first()
    flags = [i for i in range(n) if i % 1000 == 5]
    after = lambda i: next((f for f in (i - i % 1000 + 5, i - i % 1000 + 1005) if f > i and f < n), flags[0])
    before = lambda i: next((f for f in (i - i % 1000 + 5, i - i % 1000 - 995) if 0 <= f < i), flags[-1])
    assert tuple(got) == (sum(map(after, range(n))), sum(map(before, range(n))), n)
    at = {i * 7919 % n * 40_000: i for i in range(n)}
    times = sorted(at)
    wanted = {k: next((at[t] for t in times[-(-(k * 72_000_000 + 1) // 40_000) :]), None) for k in range(50)}
    assert {r["k"]: r["found_row"] for r in found.collect()} == wanted


def test_many_targets_of_one_time(spark):
    """Targets of equal times are looked up once: no window holds the targets themselves."""
    rows = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), (None, 3, 15)], "k string, row_id bigint, s long").withColumn("t", F.timestamp_seconds("s"))
    asks = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "x").alias("k"), "id", F.timestamp_seconds(F.lit(12)).alias("target_ts")).repartition(4)
    found = navigate.asof_rows(rows, "t", asks, by="k", block=2)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Window"))
    below = [line for line in lines[at : next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))]]
    assert not any("_ask" in line for line in below)
    assert [tuple(r) for r in found.groupBy("k", "found_row").count().orderBy("k").collect()] == [(None, 3, 1500), ("x", 2, 1500)]


def test_zone_gaps(spark):
    """Every quarter of an hour of the days around gaps and ambiguous hours, against zoneinfo; also long before and after all listed rules."""
    import datetime
    from zoneinfo import ZoneInfo

    utc = datetime.timezone.utc
    for zone, days in {"Europe/Berlin": ("2024-03-31", "2024-10-27", "2600-03-30"), "Australia/Lord_Howe": ("2024-10-06", "2024-04-07"), "Pacific/Apia": ("2011-12-29", "2011-12-30", "2011-12-31"), "UTC": ("2024-03-31",), "Asia/Kathmandu": ("1985-12-31", "1986-01-01")}.items():
        walls = [datetime.datetime.fromisoformat(d) + datetime.timedelta(minutes=15 * i, microseconds=i) for d in days for i in range(96)]
        df = spark.createDataFrame([(i, str(w)) for i, w in enumerate(walls)], "i long, w string").select("i", F.unix_micros(times.local_to_utc(F.col("w").cast("timestamp"), zone)).alias("at"))
        got = {r["i"]: r["at"] for r in df.collect()}
        z = ZoneInfo(zone)
        for i, w in enumerate(walls):
            at = w.replace(tzinfo=z, fold=0).astimezone(utc)
            if at.astimezone(z).replace(tzinfo=None) != w:  # a gap: the instant at which the clock jumps
                low, high = at - datetime.timedelta(days=2), at + datetime.timedelta(days=2)
                before = low.astimezone(z).utcoffset()
                while high - low > datetime.timedelta(microseconds=1):
                    mid = low + (high - low) / 2
                    low, high = (mid, high) if mid.astimezone(z).utcoffset() == before else (low, mid)
                at = high
            assert got[i] == (at - datetime.datetime(1970, 1, 1, tzinfo=utc)) // datetime.timedelta(microseconds=1), (zone, w)


def test_mined_templates(spark):
    names = [chr(97 + i) * 3 for i in range(20)]
    rows = [f"2024-05-0{i % 9 + 1} 10:00:0{i % 10} user {n} signed in from {i}" for i, n in enumerate(names * 10)]
    rows += ["disk full"] * 5 + ["disk ok"] * 5 + ["", "", None, "once upon", "a" * 300_000, " ".join(["w"] * 5_000)]
    df = spark.createDataFrame([(r,) for r in rows], "m string")
    got = {r["template"]: r["rows"] for r in patterns.mine_messages(df, "m", 0.001).collect()}
    assert got == {"<time> user <*> signed in from <n>": 200, "disk full": 5, "disk ok": 5, "": 2, "<*> <*>": 1, "<*>": 1, " ".join(["<*>"] * 5_000): 1}
    left, right = df.where("m LIKE '%user aaa%' OR m LIKE 'disk%'"), df.where("m LIKE '%user%' AND m NOT LIKE '%aaa%' OR m LIKE 'disk%'")
    assert [tuple(r) for r in patterns.diff_mined(left, right, "m", variants=8).collect()] == [("<time> user <*> signed in from <n>", 10, 190)]
    assert patterns.mine_messages(df.where("m = 'no such'"), "m").count() == 0
