"""More registered queries: strict JSON, folding and orphans, files written and read back, inference of every type, retyping, times,
anchors of snapshots, own templates, streams of several batches."""

from __future__ import annotations

import bz2
import datetime
import gzip
import itertools
import lzma
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text, times
from logloom.functions.scratch import scratch
from logloom.operators import annotate, export, filters, histogram, navigate, patterns, schema
from logloom.plans import catalogue
from logloom.plans.catalogue import SLOT, anchored, events, load, query
from logloom.sources import blocks, detect, folding, formats, growing, lines, templates
from logloom.streaming import folded, runs, stream

_BAD = """CASE WHEN event_id % 16 IN (0, 1, 2, 3, 4, 5, 6, 7, 8) THEN 'Error on line ' || (event_id + 1) || ': not a JSON object' END"""


@query(f"""SELECT event_id, {_BAD} AS error,
CASE event_id % 16 WHEN 10 THEN '{{"x": ' || event_id || ',  "y":[1, "]"]}}' WHEN 11 THEN event_id::VARCHAR WHEN 13 THEN 'tab	"' WHEN 14 THEN '18446744073709551615' WHEN 15 THEN '1.50' END AS a,
CASE event_id % 16 WHEN 10 THEN 'json' WHEN 11 THEN 'int' WHEN 12 THEN 'null' WHEN 13 THEN 'string' WHEN 14 THEN 'int' WHEN 15 THEN 'float' END AS kind,
CASE WHEN event_id % 16 > 9 THEN 1 WHEN event_id % 16 = 9 THEN 0 END AS fields FROM events""")
def json_strict(spark, d):
    cases = ['{{"a":1}} xyz', "{{'a':1}}", '{{"a":NaN}}', "[1,2,3]", '{{"a":1}}{{"b":2}}', '{{"a":1,}}', '{{"a":"x', '{{"a":1 "b":2}}', "null", "{{}}",
             '{{"a":{{"x": {0},  "y":[1, "]"]}}}}', '{{"a":1,"a":{0}}}', '{{"a":1e400}}', '{{"a":"tab\\t\\u0022"}}', '{{"a":18446744073709551615}}', '{{"a":1.50}}']
    ev = events(spark, d)
    made = F.element_at(F.array(*(F.replace(F.lit(c.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), F.col("event_id").cast("string")) for c in cases)), (F.col("event_id") % 16 + 1).cast("int"))
    out = formats.parse_jsonl(ev.select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), made.alias("raw")))
    return out.select(F.col("line_id").alias("event_id"), "error", F.col("fields")["a"].alias("a"), F.col("kinds")["a"].alias("kind"), F.when(F.col("fields").isNotNull(), F.size("fields")).alias("fields"))


#: Kind and short text of each key's value, as SQL over a row of events. Rows differ by group (event_id % 6): the type is that of the group's rows.
_KINDS = {
    "flag": ("'bool'", "NULL"), "n": ("CASE WHEN user_id IS NULL THEN 'null' ELSE 'int' END", "NULL"), "ratio": ("CASE WHEN value IS NULL THEN 'null' ELSE 'float' END", "NULL"),
    "number": ("CASE WHEN event_id % 4 = 0 THEN 'int' ELSE 'float' END", "NULL"), "both": ("CASE WHEN event_id % 2 = 0 THEN 'bool' ELSE 'int' END", "NULL"),
    "some": ("CASE WHEN event_id % 4 = 0 THEN 'bool' WHEN event_id % 3 = 0 THEN 'int' ELSE 'null' END", "NULL"),
    "nothing": ("'null'", "NULL"), "object": ("CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'int' END", "NULL"),
    "kind": ("'string'", "event_type"), "text": ("'string'", "CASE WHEN event_id % 3 = 0 THEN 'event ' || event_id ELSE 'event ' || event_id % 64 END"),
    "long": ("'string'", "CASE WHEN event_id % 50 <> 0 THEN 'short' END"), "mixed": ("CASE WHEN event_id % 50 = 0 THEN 'int' ELSE 'string' END", "CASE WHEN event_id % 50 <> 0 THEN 'a' END"),
}
_SQL_ROWS = " UNION ALL ".join(f"SELECT '{k}' || event_id % 6 AS key, {kind} AS kind, {text} AS short FROM events" for k, (kind, text) in _KINDS.items())
_SQL_TYPES = f"""SELECT key, rows, CASE
 WHEN strings >= 2 AND texts BETWEEN 1 AND 64 AND misfits <= 0.01 * present THEN 'enum' WHEN strings + jsons > 0 THEN 'string' WHEN bools > 0 AND ints + floats > 0 THEN 'any' WHEN bools > 0 THEN 'boolean'
 WHEN ints > 0 AND floats > 0 THEN 'number' WHEN ints > 0 THEN 'integer' WHEN floats > 0 THEN 'floating' ELSE 'any' END AS type
FROM (SELECT key, count(*) AS rows, count(*) FILTER (kind = 'string') AS strings, count(*) FILTER (kind = 'json') AS jsons, count(*) FILTER (kind = 'bool') AS bools, count(*) FILTER (kind = 'int') AS ints,
 count(*) FILTER (kind = 'float') AS floats, count(DISTINCT short) AS texts, count(*) FILTER (kind <> 'null') AS present, count(*) FILTER (kind NOT IN ('null', 'string') OR kind = 'string' AND short IS NULL) AS misfits
 FROM ({_SQL_ROWS}) GROUP BY key)
UNION ALL SELECT 'severity', count(*), CASE WHEN 4 * count(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'click', 'error', 'debug', 'info')) <= 4 * count(DISTINCT event_type) THEN 'level' ELSE 'enum' END FROM events
UNION ALL SELECT '@timestamp', count(*), 'time' FROM events"""


def _many_kinds(df: DataFrame) -> DataFrame:
    """Log lines with a key of every kind, as JSON."""
    even, rare = F.col("event_id") % 2 == 0, F.col("event_id") % 50 == 0
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    whole = F.col("event_id").cast("string")
    level = F.replace(F.replace(F.col("event_type"), F.lit("view"), F.lit("debug")), F.lit("click"), F.lit("info"))
    level = F.when(level.isin("debug", "info", "error"), level).otherwise("warning")
    every = lambda n: F.col("event_id") % n == 0
    values = {
        "flag": even.cast("string"), "n": F.col("user_id").cast("string"), "ratio": F.col("value").cast("string"),
        "number": F.when(every(4), whole).otherwise("0.5"), "both": F.when(even, "true").otherwise("7"), "some": F.when(every(4), "true").when(every(3), "8").otherwise("null"),
        "nothing": F.lit("null"), "object": F.when(every(3), F.lit('{"x": [1]}')).otherwise("3"),
        "kind": quoted(F.col("event_type")), "text": quoted(F.concat(F.lit("event "), F.when(every(3), whole).otherwise((F.col("event_id") % 64).cast("string")))),
        "long": quoted(F.when(rare, F.lit("x" * 65)).otherwise("short")), "mixed": F.when(rare, F.lit("1")).otherwise('"a"'),
    }
    group = (F.col("event_id") % 6).cast("string")
    parts = [F.concat(F.lit(f'"{k}'), group, F.lit('":'), F.coalesce(v, F.lit("null"))) for k, v in values.items()]
    parts += [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in (("severity", quoted(level)), ("@timestamp", quoted(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))))]
    return df.select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("raw"))


@query(f"SELECT key, type FROM ({_SQL_TYPES})")
def inferred_kinds(spark, d):
    return schema.promote(schema.profile(formats.parse_jsonl(_many_kinds(lines.spread(events(spark, d), "event_id"))))).select("key", "type")


@query(f"""WITH t AS ({_SQL_TYPES}) SELECT key, (row_number() OVER (ORDER BY CASE type WHEN 'time' THEN 0 WHEN 'level' THEN 1 ELSE 2 END, key) - 1)::INT AS place, type FROM t""")
def ordered_schema(spark, d):
    """Time first, level second, the others by name."""
    found = schema.infer_schema(formats.parse_jsonl(_many_kinds(lines.spread(events(spark, d), "event_id"))))
    return spark.createDataFrame([(f.name, i, f.type) for i, f in enumerate(found.fields)], "key string, place int, type string")


@query("""SELECT CASE WHEN count(DISTINCT event_type) <= 64 THEN 'enum' ELSE 'string' END AS kind, CASE WHEN count(DISTINCT event_id) <= 64 THEN 'enum' ELSE 'string' END AS text, count(*) AS rows FROM events""")
def redetected(spark, d):
    ev = events(spark, d).withColumn("text", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return ev.agg(F.lit(schema.redetect(ev, "event_type")).alias("kind"), F.lit(schema.redetect(ev, "text")).alias("text"), F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END::BIGINT AS n, CASE WHEN event_id % 3 = 2 THEN date_trunc('second', ts) END AS at FROM events")
def retyped(spark, d):
    """Two text columns pinned to types; what does not fit is null."""
    ev = events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("n"), F.when(F.col("event_id") % 3 == 2, F.date_format("ts", "dd.MM.yyyy HH-mm-ss")).otherwise("never").alias("at"))
    out = schema.retype(schema.retype(ev, "n", "integer"), "at", "time", ("%d.%m.%Y %H-%M-%S",))
    return out.select("event_id", F.col("n").cast("long").alias("n"), F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT ts, event_id AS id, event_type FROM events WHERE user_id IS NOT NULL")
def ordered_columns(spark, d):
    """Reordered and renamed; a hidden column still filters."""
    ev = events(spark, d).select("event_id", "event_type", "user_id", "ts").where("user_id IS NOT NULL")
    return schema.columns_in_order(ev, ["ts", "event_id"], hidden=("user_id",), names={"event_id": "id"})


@query("SELECT event_id FROM events WHERE event_type = 'error' OR event_type = ''")
def f_bound_keys(spark, d):
    """A rule on a field that is found by a subset of its keys; an empty needle is refused but for an exact one."""
    bound = schema.LogSchema([schema.Field("user", ["user_id"]), schema.Field("event_type", ["level", "event_type"])]).bind(["level"])
    try:
        filters.contains(bound.name, "")
    except ValueError:
        rule = filters.any_of(filters.exactly(bound.name, "error"), filters.exactly(bound.name, ""))
        return filters.where(events(spark, d), rule).select("event_id")
    raise AssertionError("an empty needle went through")


# folding and orphans

_BLOCKS = "SELECT event_id // 50 AS b, event_id % 50 AS l, event_type = 'view' AS more, CASE WHEN event_type = 'view' THEN 'at ' || props ELSE event_type || ' ' || props END AS raw FROM events"


def _blocks(df: DataFrame) -> DataFrame:
    """A file for every 50 events, in which views continue the record before them."""
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("at "), F.col("props"))).otherwise(F.concat_ws(" ", "event_type", "props"))
    return df.select(F.concat(F.lit("b"), F.floor(F.col("event_id") / 50).cast("string")).alias("source"), (F.col("event_id") % 50).alias("line_id"), raw.alias("raw"))


@query(f"""WITH r AS (SELECT *, sum((NOT more)::INT) OVER (PARTITION BY b ORDER BY l) AS rid FROM ({_BLOCKS}))
SELECT 'b' || b AS source, min(l) AS line_id, string_agg(raw, chr(10) ORDER BY l) AS raw FROM r WHERE rid > 0 GROUP BY b, rid""")
def fold_until_header(spark, d):
    t = templates.Template("events", r"^(?<kind>(?!at )\w+) (?<props>\{.*)", continuation="untilNextHeader")
    return folding.fold(_blocks(events(spark, d)), t)


@query(f"""WITH r AS (SELECT *, sum((NOT more)::INT) OVER (PARTITION BY b ORDER BY l) AS rid FROM ({_BLOCKS})), o AS (SELECT b, min(l) AS f, max(l) AS t, count(*) AS n FROM r WHERE rid = 0 GROUP BY b)
SELECT 'b' || b AS source, f AS first, t AS last, 'Error on ' || CASE WHEN n = 1 THEN 'line ' || (f + 1) ELSE 'lines ' || (f + 1) || '-' || (t + 1) END || ': ' || n || ' orphaned continuation line(s)' AS error FROM o""")
def orphans(spark, d):
    return folding.orphans(_blocks(events(spark, d)), ~F.col("raw").startswith("at "))


# files


@query("SELECT line_id, raw, rows FROM (SELECT event_id AS line_id, props || CASE WHEN event_id % 3 = 0 THEN chr(13) ELSE '' END AS raw FROM events), (SELECT count(*) AS rows FROM events)")
def lines_back(spark, d):
    """Lines with one or two carriage returns in gzip files, read again by name and by content: one return is no part of a line. A task
    writes a range of the lines, in files that follow each other by the numbers in their names."""
    path = scratch(spark, "lines")
    ends = F.when(F.col("event_id") % 3 == 0, "\r\r").otherwise("\r")
    export.write_lines(export.raw_lines(events(spark, d).select("event_id", F.concat("props", ends).alias("raw")).orderBy("event_id")), path, "gzip", 65_536)
    part, chunk = (F.regexp_extract("source", pattern, 1).cast("int") for pattern in (r"part-(\d+)-[^/]*$", r"-c(\d+)[^/]*$"))
    by_name, by_content = lines.numbered_on(lines.read_lines(spark, path), part, chunk), lines.read_compressed(spark, path)
    return by_name.join(by_content.agg(F.count(F.lit(1)).alias("rows")), how="cross").select("line_id", "raw", "rows")


_KINDS = ("gzip", "bzip2", "xz", "zstd", "none")


_PACK = {"gzip": gzip.compress, "bzip2": bz2.compress, "xz": lambda x: lzma.compress(x, preset=0), "zstd": lambda x: zstandard.ZstdCompressor().compress(x), "none": bytes}


def _frames(path: str, frame: int):
    """Writes rows (name, number, line) of a partition sorted by these to files of frames of `frame` lines each. A file gets its name when
    it is whole, so a task that is run again leaves it as it is."""

    def run(batches):
        system, top = blocks.local(path)
        system.create_dir(top, recursive=True)
        parts = (part for b in batches for part in b.groupby("name", sort=False))
        for name, group in itertools.groupby(parts, key=lambda p: p[0]):
            hidden = f"{top}/.{uuid.uuid4().hex}"
            pack, n = _PACK[name.rsplit(".", 1)[1]], 0
            with system.open_output_stream(hidden) as out:
                for _, part in group:
                    lines = [x.encode() + b"\n" for x in part["line"]]
                    n += len(lines)
                    for at in range(0, len(lines), frame):
                        out.write(pack(b"".join(lines[at : at + frame])))
            system.move(hidden, f"{top}/{name}")
            yield pd.DataFrame({"name": [name], "lines": [n]})

    return run


def _written_frames(df: DataFrame, frame: int) -> str:
    """A new folder of the files that df (name, number, line) states, their codec at the end of the name."""
    path = scratch(df.sparkSession, "frames")
    placed = df.select("name", "number", "line").repartition("name").sortWithinPartitions("name", "number")
    placed.mapInPandas(_frames(path, frame), "name string, lines long").agg(F.sum("lines")).collect()  # one row
    return path


@query(f"""SELECT codec, doc_id % 2 AS parity, count(*) AS rows, sum(doc_id)::BIGINT AS ids, sum(n)::BIGINT AS numbers, sum(length(text))::BIGINT AS letters
FROM (SELECT doc_id, codec, row_number() OVER (PARTITION BY codec, doc_id // 20480 ORDER BY doc_id) - 1 AS n, text
FROM (SELECT doc_id, (list_value({", ".join(f"'{k}'" for k in _KINDS)}))[(doc_id % 5 + 1)::INT] AS codec, translate(coalesce(text, ''), chr(10) || chr(13), '  ') AS text FROM documents)) GROUP BY ALL""")
def lines_of_frames(spark, d):
    """The documents as lines of files of five codecs, at most 4 096 lines a file, written in frames of 50 and read again in pieces of
    256 KB: numbers and texts come back whole."""
    codec = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20480).cast("string"), F.lit("."), codec)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "))
    path = _written_frames(load(spark, d, "documents").select(name.alias("name"), F.col("doc_id").alias("number"), line.alias("line")), 50)
    back = lines.read_compressed(spark, path, piece=1 << 18).withColumn("id", F.substring_index("raw", " ", 1))
    parts = back.select(F.substring_index("source", ".", -1).alias("codec"), (F.col("id").cast("long") % 2).alias("parity"), F.col("id").cast("long").alias("id"), "line_id", (F.length("raw") - F.length("id") - 1).alias("letters"))
    return parts.groupBy("codec", "parity").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.sum("line_id").alias("numbers"), F.sum("letters").alias("letters"))


@query("""SELECT 'p' || (page_id // 200) || '_' || (page_id % 20) || '.' || (list_value('gzip', 'bzip2', 'xz', 'zstd', 'none'))[(page_id % 5 + 1)::INT] AS source,
CASE WHEN count(*) = 1 AND page_id % 4 > 1 THEN 'json' ELSE (list_value('json', 'logfmt', 'csv', 'regex'))[(page_id % 4 + 1)::INT] END AS format FROM pages GROUP BY page_id // 200, page_id % 20, page_id % 5, page_id % 4""")
def detect_files(spark, d):
    """Files of four formats and five codecs, ten pages each, told by their heads alone; one line is too few for a template or CSV."""
    p = load(spark, d, "pages").withColumn("k", F.col("page_id") % 4)
    name = F.concat(F.lit("p"), F.floor(F.col("page_id") / 200).cast("string"), F.lit("_"), (F.col("page_id") % 20).cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % 5 + 1).cast("int")))
    site = F.substring_index("url", "?", 1)
    line = F.when(F.col("k") == 0, F.to_json(F.struct("page_id", "url"))).when(F.col("k") == 1, F.concat(F.lit("id="), F.col("page_id").cast("string"), F.lit(' url="'), site, F.lit('"')))
    line = line.when(F.col("k") == 2, F.concat_ws(",", F.col("page_id").cast("string"), site)).otherwise(F.concat(F.lit("2024-04-28T04:02:03.123Z stdout F page "), F.col("page_id").cast("string")))
    path = _written_frames(p.select(name.alias("name"), F.col("page_id").alias("number"), line.alias("line")), 50)
    return detect.detect_files(spark, path).select(F.element_at(F.split("source", "/"), -1).alias("source"), "format")


@query(f"SELECT event_id AS row_id, colour, 'note ' || event_id AS note, event_type, (SELECT count(*) FROM events) AS rows FROM (SELECT *, {SLOT} AS colour FROM events) WHERE colour IS NOT NULL")
def snapshot(spark, d):
    """A table and its anchors, written and read again."""
    path = scratch(spark, "snapshot")
    ev = anchored(events(spark, d)).withColumn("source", F.lit("e")).withColumn("line_id", F.col("event_id")).withColumn("row_id", F.col("event_id"))
    marked = ev.where("slot IS NOT NULL").select("source", "line_id", F.col("slot").alias("colour"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    gone = marked.limit(1).withColumn("source", F.lit(""))  # anchors without a source are not kept
    export.write_snapshot(ev.drop("slot"), path, annotate.persisted_anchors(marked.unionByName(gone)))
    rows = export.read_snapshot(spark, path)
    return spark.read.parquet(f"{path}/anchors").join(rows.select("row_id", "event_type"), "row_id").withColumn("rows", F.lit(rows.count()).cast("long")).select("row_id", "colour", "note", "event_type", "rows")


@query("SELECT 'e' AS source, event_id AS line_id, 7 AS colour, 'late' AS note FROM events WHERE value > 150")
def replaced_anchors(spark, d):
    found = events(spark, d).where("value > 150").select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"))
    return annotate.persisted_anchors(annotate.replace_anchors(found, 99, " late\n"))


# times and texts


@query("""SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS with_offset, date_trunc('second', ts) AS syslog, date_trunc('minute', ts) AS own, ts - INTERVAL 1 HOUR AS berlin, epoch_us(ts) AS micros,
event_type || ' ' || user_id AS shown FROM events""")
def times_read(spark, d):
    ev = events(spark, d)
    ntz = lambda c: c.cast("timestamp_ntz")
    offset = times.offset_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    syslog = times.syslog_timestamp(F.date_format("ts", "MMM d HH:mm:ss"), datetime.date(2024, 2, 1))
    own = times.parse_time(F.date_format("ts", "dd.MM.yy 'at' HH:mm"), ("%d.%m.%y at %H:%M",))
    shown = text.display(F.concat(F.col("event_type"), F.lit(" \n\t"), F.col("user_id").cast("string"), F.lit(" ")))
    return ev.select("event_id", ntz(offset).alias("with_offset"), ntz(syslog).alias("syslog"), ntz(own).alias("own"), ntz(times.local_to_utc(F.col("ts").cast("timestamp"), "Europe/Berlin")).alias("berlin"), times.epoch_micros(F.col("ts")).alias("micros"), shown.alias("shown"))


_ZONE_CASES = """SELECT event_id, event_id % 4 AS c, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-31 00:00:00' WHEN 1 THEN TIMESTAMP '2024-10-27 00:00:00' WHEN 2 THEN TIMESTAMP '2024-10-06 00:00:00' ELSE TIMESTAMP '2011-12-29 12:00:00' END + to_minutes((event_id // 4 * CASE WHEN event_id % 4 = 3 THEN 11 ELSE 1 END % CASE WHEN event_id % 4 = 3 THEN 2880 ELSE 360 END)::INT) AS w FROM events"""


@query(f"""SELECT event_id, CASE c WHEN 0 THEN CASE WHEN w < TIMESTAMP '2024-03-31 02:00:00' THEN w - INTERVAL 1 HOUR WHEN w < TIMESTAMP '2024-03-31 03:00:00' THEN TIMESTAMP '2024-03-31 01:00:00' ELSE w - INTERVAL 2 HOUR END
WHEN 1 THEN CASE WHEN w < TIMESTAMP '2024-10-27 03:00:00' THEN w - INTERVAL 2 HOUR ELSE w - INTERVAL 1 HOUR END
WHEN 2 THEN CASE WHEN w < TIMESTAMP '2024-10-06 02:00:00' THEN w - INTERVAL 630 MINUTE WHEN w < TIMESTAMP '2024-10-06 02:30:00' THEN TIMESTAMP '2024-10-05 15:30:00' ELSE w - INTERVAL 11 HOUR END
ELSE CASE WHEN w < TIMESTAMP '2011-12-30 00:00:00' THEN w + INTERVAL 10 HOUR WHEN w < TIMESTAMP '2011-12-31 00:00:00' THEN TIMESTAMP '2011-12-30 10:00:00' ELSE w - INTERVAL 14 HOUR END END AS at FROM ({_ZONE_CASES})""")
def zone_gaps(spark, d):
    """Wall-clock times around the gap and the ambiguous hour of Berlin, the half-hour gap of Lord Howe and the day that Apia left out."""
    c = F.col("event_id") % 4
    step = F.floor(F.col("event_id") / 4)
    minutes = F.when(c == 3, step * 11 % 2880).otherwise(step % 360)
    starts = F.element_at(F.array(*(F.lit(t).cast("timestamp") for t in ("2024-03-31 00:00:00", "2024-10-27 00:00:00", "2024-10-06 00:00:00", "2011-12-29 12:00:00"))), (c + 1).cast("int"))
    ev = events(spark, d).select("event_id", c.alias("c"), (starts + F.make_dt_interval(mins=minutes.cast("int"))).alias("w"))
    zones = ("Europe/Berlin", "Europe/Berlin", "Australia/Lord_Howe", "Pacific/Apia")
    at = F.coalesce(*(F.when(F.col("c") == i, times.local_to_utc(F.col("w"), z)) for i, z in enumerate(zones)))
    return ev.select("event_id", at.cast("timestamp_ntz").alias("at"))


@query("SELECT event_id FROM events WHERE contains(strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0'), ' 08:3') OR strftime(ts, '%H:%M') = '23:59'")
def f_shown_time(spark, d):
    """Text rules see a time as it is shown."""
    return filters.where(events(spark, d), filters.any_of(filters.contains("ts", " 08:3"), filters.contains("ts", " 23:59:"))).select("event_id")


# own templates


@query("SELECT 'f' || (event_id % 20) AS source, 'regex' AS format, 'events' AS template FROM events GROUP BY 1 HAVING count(*) > 1")
def own_template(spark, d):
    """A template of one's own, checked by its samples, tells files that no built-in one does."""
    own = templates.Template("events", r"^#(?<id>\d+) <(?<kind>\w+)> (?<rest>.*)$", 1, samples=("#1 <view> {}", "#20 <error> x"))
    if templates.faults(own) or not templates.faults(templates.Template("broken", own.pattern, samples=("view",))):
        raise AssertionError("the samples decide")
    raw = events(spark, d).select(F.format_string("f%d", F.col("event_id") % 20).alias("source"), F.floor(F.col("event_id") / 20).alias("line_id"), F.format_string("#%d <%s> %s", "event_id", "event_type", "props").alias("raw"))
    return detect.detect_formats(raw, (own,)).where("template = 'events'")


# templates of similar lines

_LETTERS = "translate(CAST(user_id % 97 AS STRING), '0123456789', 'abcdefghij')"
_MESSAGE = f"concat(event_type, ' by ', {_LETTERS}, ' of ', CASE WHEN event_id % 500 = 0 THEN translate(CAST(event_id AS STRING), '0123456789', 'klmnopqrst') ELSE concat('team ', CASE WHEN event_id % 2 = 0 THEN 'red' ELSE 'blue' END) END)"
_SQL_MINED = """WITH m AS (SELECT *, string_split(msg, ' ') AS ws FROM (SELECT event_id, {message} AS msg FROM events)),
p AS (SELECT event_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM m),
f AS (SELECT n, i, w FROM p GROUP BY ALL HAVING count(*) >= greatest(2, ceil(0.001 * (SELECT count(*) FROM m)))),
k AS (SELECT event_id, list(CASE WHEN f.w IS NULL THEN '<*>' ELSE p.w END ORDER BY i) AS t FROM p LEFT JOIN f USING (n, i, w) GROUP BY event_id),
l AS (SELECT t, count(*) AS c FROM k GROUP BY t),
g AS (SELECT t, i, t[i] AS w, list_concat(list_concat(t[1:i - 1], ['<*>']), t[i + 1:]) AS r FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM l)),
v AS (SELECT i, r FROM g WHERE w <> '<*>' GROUP BY i, r HAVING count(*) >= 8),
x AS (SELECT t, list(i) AS vs FROM g JOIN v USING (i, r) WHERE w <> '<*>' GROUP BY t),
mined AS (SELECT l.t AS t0, array_to_string([CASE WHEN list_contains(coalesce(vs, []), i) THEN '<*>' ELSE l.t[i] END FOR i IN range(1, len(l.t) + 1)], ' ') AS template, c FROM l LEFT JOIN x USING (t))
"""


@query(_SQL_MINED.replace("{message}", _MESSAGE) + "SELECT template, sum(c)::BIGINT AS rows FROM mined GROUP BY template")
def mined_templates(spark, d):
    """Messages with user names, each of them frequent, and rare words: both are told as variable."""
    return patterns.mine_messages(events(spark, d).withColumn("msg", F.expr(_MESSAGE)), "msg")


@query(_SQL_MINED.replace("{message}", _MESSAGE) + """SELECT template, count(*) FILTER (event_id % 3 = 0) AS left_rows, count(*) FILTER (event_id % 3 > 0) AS right_rows FROM k JOIN mined ON k.t = t0 GROUP BY template
HAVING left_rows <> right_rows""")
def diff_mined(spark, d):
    ev = events(spark, d).withColumn("msg", F.expr(_MESSAGE))
    return patterns.diff_mined(ev.where("event_id % 3 = 0"), ev.where("event_id % 3 > 0"), "msg")


# navigation with a crowded hour


@query("""SELECT o.o_orderkey, e.ts AS found_ts, e.event_id AS found_row FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_microseconds((o_orderkey * 7919 % 3600)::BIGINT * 1000000) AS target_ts FROM orders) o
ASOF LEFT JOIN (SELECT ts, min(event_id) AS event_id FROM (SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds((event_id * 104729 % 3600000)::BIGINT * 1000) AS ts FROM events) GROUP BY ts) e ON o.target_ts <= e.ts""")
def asof_crowded(spark, d):
    """All rows in one hour: the bucket is cut into parts."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ev = events(spark, d).select("event_id", (start + F.make_dt_interval(secs=(F.col("event_id") * 104729 % 3600000 / 1000).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"))
    asks = load(spark, d, "orders").select("o_orderkey", (start + F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 3600).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("target_ts"))
    return navigate.asof_rows(ev, "ts", asks, row_id="event_id", block=500).select("o_orderkey", "found_ts", "found_row")


@query("""SELECT epoch_us(ts - p) / 1e6 AS gap_seconds, r AS row_before, event_id AS row_after FROM (SELECT event_id, ts, lag(ts) OVER w AS p, lag(event_id) OVER w AS r FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE p IS NOT NULL ORDER BY gap_seconds DESC, row_after LIMIT 25""")
def time_gaps_in_parts(spark, d):
    return patterns.time_gaps(events(spark, d), "ts", "event_id", 25, block=200).select("gap_seconds", "row_before", "row_after")


# streams of several batches


#: Events of a file of a stream.
_FILE = 65_536


def _in_parts(spark, d, parts: int = 3, rows: int = _FILE) -> DataFrame:
    """The events as a stream of several batches, oldest first. A batch is as many files of about `rows` rows, so its work is many tasks."""
    path = scratch(spark, "parts")
    ev = events(spark, d)
    last, n = ev.agg(F.max("event_id"), F.count(F.lit(1))).first()
    ends = [-(-i * ((last or 0) + 1) // parts) for i in range(parts + 1)]
    files = max(1, -(-n // (parts * rows)))
    for i in range(parts):  # one part after the other: a stream takes the older first
        inside = F.col("event_id") < ends[i + 1] if i == 0 else (F.col("event_id") >= ends[i]) & (F.col("event_id") < ends[i + 1])
        ev.where(inside).repartition(files).write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - lines.files_of(spark, path).count()):  # a task without rows wrote none
            spark.createDataFrame([], ev.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'j' ELSE 'c' END AS source, event_id, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 2 = 1 THEN event_type END AS level FROM events""")
def stream_detect(spark, d):
    """JSON and CSV lines in one stream: formats and the CSV header are told once and kept over batches."""
    ev = _in_parts(spark, d)
    odd = F.col("event_id") % 2 == 1
    raw = F.when(odd, F.concat_ws(",", F.col("event_id").cast("string"), "event_type")).otherwise(F.col("props"))
    made = ev.select(F.when(odd, "c").otherwise("j").alias("source"), (F.col("event_id") + 10).alias("line_id"), raw.alias("raw"))
    head = ev.where("event_id = 1").select(F.lit("c").alias("source"), F.lit(0).cast("long").alias("line_id"), F.lit("id,level").alias("raw"))
    path, out = scratch(spark, "formats"), scratch(spark, "told")
    sink = stream.appending(out)
    told = stream.detect_then_parse({"json": formats.parse_jsonl, "csv": formats.parse_csv}, detect.detect_formats, sink, path)
    stream.drain(made.unionByName(head), told)
    rows = stream.appended(spark, out).where("error IS NULL").select("source", (F.col("line_id") - 10).alias("event_id"), "fields")
    return rows.select("source", "event_id", F.col("fields")["k"].cast("long").alias("k"), F.col("fields")["level"].alias("level"))


@query("SELECT event_id, event_id % 2 = 0 AS history FROM events")
def stream_after_history(spark, d):
    """Rotated history first, then the live stream in the same table."""
    path = scratch(spark, "joined")
    history = events(spark, d).where("event_id % 2 = 0").select("event_id", F.lit(True).alias("history"))
    live = _in_parts(spark, d).where("event_id % 2 = 1").select("event_id", F.lit(False).alias("history"))
    stream.history_then_live(history, live, path, scratch(spark, "stream"), availableNow=True).awaitTermination()
    return stream.appended(spark, path)


@query("""SELECT event_type, max(ts) AS last_ts, coalesce(bool_and(ok), true) AS monotonic FROM (SELECT event_type, ts, ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS ok FROM events) GROUP BY 1""")
def stream_monotonic_parts(spark, d):
    sink = stream.Merged(spark, scratch(spark, "merged"), stream.merge_order("ts", "event_id", "event_type"))
    stream.drain(_in_parts(spark, d).select("event_id", "event_type", "ts"), sink)
    return sink.table()


@query(f"WITH t AS ({_SQL_TYPES}) SELECT key, rows, type FROM t")
def stream_profile_parts(spark, d):
    """Keys of every kind, profiled batch by batch."""
    sink = stream.Merged(spark, scratch(spark, "merged"), stream.merge_profile)
    stream.drain(formats.parse_jsonl(_many_kinds(_in_parts(spark, d))), sink)
    return schema.promote(sink.table()).select("key", "rows", "type")


@query(f"""WITH kept AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000)
SELECT date_trunc('day', ts) AS bucket_start, count(*) AS total, count(*) FILTER ({SLOT} IS NOT NULL) AS anchors FROM kept GROUP BY 1""")
def stream_evicted(spark, d):
    """Retained rows only: their histogram, and the anchors that are left."""
    sink = stream.Merged(spark, scratch(spark, "merged"), stream.retain_last(1000, "event_id"))
    rows = _in_parts(spark, d).select("event_id", "ts", "event_type", F.lit("e").alias("source"), F.col("event_id").alias("line_id"))
    stream.drain(rows, sink)
    kept = sink.table()
    marked = anchored(events(spark, d)).where("slot IS NOT NULL").select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.col("slot").alias("colour"), F.lit(None).cast("string").alias("note"))
    left = annotate.with_anchors(kept, stream.drop_evicted(marked, kept))
    counts = histogram.histogram(kept, "ts", "event_type", 86_400).select("bucket_start", "total")
    return counts.join(left.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket_start")).agg(F.count("colour").alias("anchors")), "bucket_start")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def stream_retention_parts(spark, d):
    sink = stream.Merged(spark, scratch(spark, "merged"), stream.retain_last(1000, "event_id"))
    stream.drain(_in_parts(spark, d).select("event_id"), sink)
    return sink.table()


@query("SELECT event_id FROM events")
def stream_rotated(spark, d):
    """Log files that are renamed between batches while others take their names: each line once."""
    import os

    folder = scratch(spark, "growing").removeprefix("file:").replace("///", "/")
    out, checkpoint = scratch(spark, "followed"), scratch(spark, "stream")
    os.makedirs(f"{folder}/logs")
    events(spark, d).select((F.col("event_id") % 3).alias("part"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("value")).write.partitionBy("part").text(f"{folder}/written")
    for part in range(3):
        for age in range(part, 0, -1):
            for name in sorted(os.listdir(f"{folder}/logs")):
                stem, _, number = name.partition(".log")
                if number == (f".{age - 1}" if age > 1 else ""):
                    os.rename(f"{folder}/logs/{name}", f"{folder}/logs/{stem}.log.{age}")
        written = f"{folder}/written/part={part}"
        for k, name in enumerate(sorted(n for n in os.listdir(written) if n.endswith(".txt"))):
            os.rename(f"{written}/{name}", f"{folder}/logs/app{k}.log")
        sink = growing.Numbered(f"{folder}/counts", stream.appending(out), 1 << 20)
        stream.start(growing.follow(spark, f"{folder}/logs/*.log*", split=1 << 20), sink, checkpoint, availableNow=True).awaitTermination()
    got = stream.appended(spark, out)
    return got.select(F.regexp_extract("raw", r"^event (\d+)$", 1).cast("long").alias("event_id")).join(got.groupBy("file").agg(F.countDistinct("line_id").alias("n"), F.max("line_id").alias("last")).where("n <> last + 1").limit(1).select(F.lit(1).alias("wrong")), F.lit(True), "left").where("wrong IS NULL").select("event_id")


@query("""WITH l AS (SELECT event_id % 10 = 0 AS few, CASE WHEN event_id % 10 = 0 THEN event_id // 10 ELSE event_id - event_id // 10 - 1 END AS line_id, event_type = 'view' AS more,
CASE WHEN event_type = 'view' THEN '  at ' || props ELSE event_type || ' ' || props END AS raw FROM events),
r AS (SELECT *, CASE WHEN few THEN 'b' ELSE 'a' END AS source, sum((NOT more)::INT) OVER (PARTITION BY few ORDER BY line_id) AS rid FROM l)
SELECT source, min(line_id)::BIGINT AS line_id, string_agg(raw, chr(10) ORDER BY line_id) AS raw, NULL::VARCHAR AS error FROM r WHERE rid > 0 GROUP BY source, rid
UNION ALL SELECT source, min(line_id)::BIGINT, NULL, 'Error on ' || CASE WHEN count(*) = 1 THEN 'line ' || (min(line_id) + 1) ELSE 'lines ' || (min(line_id) + 1) || '-' || (max(line_id) + 1) END || ': ' || count(*) || ' orphaned continuation line(s)'
FROM r WHERE rid = 0 GROUP BY source""")
def stream_fold_hot(spark, d):
    """Nine of ten lines are of one source: records over three batches, folded by blocks, and what is open at the end."""
    few, out = F.col("event_id") % 10 == 0, scratch(spark, "records")
    tenth = F.floor(F.col("event_id") / 10)
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("  at "), F.col("props"))).otherwise(F.concat_ws(" ", "event_type", "props"))
    rows = _in_parts(spark, d).select(F.when(few, "b").otherwise("a").alias("source"), F.when(few, tenth).otherwise(F.col("event_id") - tenth - 1).alias("line_id"), raw.alias("raw"))
    sink = folded.Folded(spark, scratch(spark, "open"), folding.indented_header, stream.appending(out), 3_600_000, block=4_096)
    stream.drain(rows, sink)
    return stream.appended(spark, out).unionByName(sink.pending())


@query("""SELECT event_id, value, place FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN round(value) END AS value, (row_number() OVER (ORDER BY CASE WHEN event_id % 9 > 0 THEN round(value) END DESC NULLS FIRST, event_id) - 1)::BIGINT AS place, count(*) OVER () AS n FROM events)
WHERE place < 100 OR place BETWEEN n // 2 AND n // 2 + 299 OR place >= n - 100""")
def stream_sorted(spark, d):
    """Three pages of the sorted view of a stream: the first, one in the middle, the last. Values have many ties and a null head."""
    rows = _in_parts(spark, d).select("event_id", F.when(F.col("event_id") % 9 > 0, F.round("value")).alias("value"))
    view = runs.SortedRuns(spark, scratch(spark, "view"), "value", True, "event_id", block=1_024)
    stream.drain(rows, view)
    n = view.table().agg(F.sum("rows")).first()[0]
    out = None
    for a, b in ((0, 100), (n // 2, n // 2 + 300), (n - 100, n)):
        inside = Window.orderBy(F.col("value").desc_nulls_first(), "event_id")  # the rows of a page
        page = view.page(a, b).withColumn("place", (F.row_number().over(inside) - 1 + a).cast("long"))
        out = page if out is None else out.unionByName(page)
    return out


@query(f"""WITH kept AS (SELECT * FROM {catalogue._EV} ORDER BY event_id DESC LIMIT 1000)
SELECT date_trunc('hour', ts) AS bucket_start, {catalogue._SQL_COUNTS} FROM kept WHERE ts IS NOT NULL GROUP BY 1""")
def stream_histogram_evicted(spark, d):
    """The histogram of the newest rows only: rows that are pushed out come as negative counts."""
    sink = runs.RetainedHistogram(spark, scratch(spark, "kept"), "ts", "event_type", 3600, 1000, "event_id", catalogue.MAPPING, block=512)
    stream.drain(_in_parts(spark, d, 4).select("event_id", "ts", "event_type"), sink)
    return sink.histogram()


@query("""SELECT parser, event_id, length(repeat(event_type || ' "', CASE WHEN event_id % 1000 = 0 THEN 10000 ELSE 1 END)) AS n FROM events, (VALUES ('json'), ('logfmt'), ('csv')) p(parser)""")
def long_values(spark, d):
    """Quoted values of up to some 70 000 characters, full of escapes, in each parser."""
    ev = events(spark, d).withColumn("t", F.repeat(F.concat("event_type", F.lit(' "')), F.when(F.col("event_id") % 1000 == 0, 10_000).otherwise(1)))
    escaped, doubled = F.replace("t", F.lit('"'), F.lit('\\"')), F.replace("t", F.lit('"'), F.lit('""'))
    made = {
        "json": (formats.parse_jsonl, F.concat(F.lit('\t{"k": "'), escaped, F.lit('"}'))),
        "logfmt": (formats.parse_logfmt, F.concat(F.lit('k="'), escaped, F.lit('"'))),
        "csv": (formats.parse_csv, F.concat(F.lit('"'), doubled, F.lit('"'))),
    }
    out = None
    for name, (parse, raw) in made.items():
        rows = ev.select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), raw.alias("raw"))
        if name == "csv":
            rows = rows.unionByName(ev.agg((F.min("event_id") - 1).alias("line_id")).select(F.lit("e").alias("source"), "line_id", F.lit("k").alias("raw")))
        own = parse(rows).where("error IS NULL").select(F.lit(name).alias("parser"), F.col("line_id").alias("event_id"), F.length(F.col("fields")["k"]).cast("long").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


# merging


@query("SELECT 'f' AS source, event_id AS line_id, CASE WHEN event_id % 3 < 2 THEN 0 ELSE 1 END AS source_rank, event_type FROM events UNION ALL SELECT 'g', event_id, 1, event_type FROM events WHERE event_id % 5 = 0")
def merge_repeated(spark, d):
    """A file that two loads hold in part: its lines come once, from the first load that has them."""
    ev = events(spark, d).select(F.lit("f").alias("source"), F.col("event_id").alias("line_id"), "event_type")
    other = ev.where("line_id % 5 = 0").withColumn("source", F.lit("g"))
    return lines.merge_sources(ev.where("line_id % 3 < 2"), ev.where("line_id % 3 > 0").unionByName(other)).select("source", "line_id", "source_rank", "event_type")
