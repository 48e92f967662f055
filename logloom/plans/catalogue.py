"""Registered queries over the driver's tables, with the DuckDB SQL for the same rows.

`events` is the main log table: event_id is the row's number, ts its time, event_type its level by MAPPING.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import levels, text, times
from logloom.operators import annotate, export, filters, histogram, navigate, patterns, schema, sorting
from logloom.sources import formats, lines
from logloom.sources import folding, templates
from logloom.sources import detect

MAPPING = {"error": "Error", "purchase": "Warn", "signup": "Info", "click": "Debug", "view": "Trace"}
_SQL_RANK = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END"
_SQL_COUNTS = ", ".join([f"count(*) FILTER (lvl IS NULL) AS unknown", *(f"count(*) FILTER (lvl = {i}) AS {n.lower()}" for i, n in enumerate(levels.CANONICAL)), "count(*) AS total"])
_EV = f"(SELECT *, {_SQL_RANK} AS lvl FROM events)"
SLOT = "CASE WHEN event_id % 7 = 0 THEN event_id % 8 END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def anchored(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.expr(SLOT))


# histograms


@query(f"SELECT date_trunc('hour', ts) AS bucket_start, {_SQL_COUNTS} FROM {_EV} WHERE ts IS NOT NULL GROUP BY 1")
def hist_1h_levels(spark, d):
    return histogram.histogram(events(spark, d), "ts", "event_type", 3600, MAPPING)


@query(f"""WITH h AS (SELECT date_trunc('day', ts) AS b, {_SQL_COUNTS} FROM {_EV} WHERE ts IS NOT NULL GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(b) FROM h), (SELECT max(b) FROM h), INTERVAL 1 DAY)) AS b)
SELECT g.b AS bucket_start, {', '.join(f'coalesce({n}, 0) AS {n}' for n in (*histogram.SLOTS, 'total'))} FROM g LEFT JOIN h USING (b)""")
def hist_dense_1d(spark, d):
    return histogram.histogram(events(spark, d), "ts", "event_type", 86400, MAPPING, dense=True)


@query(f"""WITH s AS (SELECT min(epoch_us(ts)) a, max(epoch_us(ts)) z FROM events),
r AS (SELECT coalesce((SELECT min(w) FROM (VALUES (1::BIGINT), (10), (60), (600), (3600), (86400)) t(w), s WHERE (z - a) // (w * 1000000) + 1 <= 500), 86400)::BIGINT AS w)
SELECT make_timestamp((epoch_us(ts) // (w * 1000000) * w * 1000000)::BIGINT) AS bucket_start, {_SQL_COUNTS} FROM {_EV}, r WHERE ts IS NOT NULL GROUP BY 1""")
def hist_auto_rung(spark, d):
    return histogram.histogram(events(spark, d), "ts", "event_type", "auto", MAPPING)


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM events")
def hist_span(spark, d):
    return histogram.span(events(spark, d), "ts")


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS b, {_SQL_COUNTS} FROM {_EV} GROUP BY 1)
SELECT min(b) AS first_bucket, max(b) AS last_bucket, {', '.join(f'sum({n})::BIGINT AS {n}' for n in (*histogram.SLOTS, 'total'))} FROM h WHERE b BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 23:00:00'""")
def hist_level_totals(spark, d):
    h = hist_1h_levels(spark, d)
    return histogram.level_totals(h, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-09 23:00:00").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS bucket_start, date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS bucket_end, count(*) AS total FROM events GROUP BY 1, 2")
def hist_bucket_bounds(spark, d):
    return histogram.bucket_bounds(hist_1h_levels(spark, d), 3600).select("bucket_start", "bucket_end", "total")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'")
def hist_rows_of_bucket(spark, d):
    return histogram.rows_of_bucket(events(spark, d), "ts", datetime.datetime(2024, 1, 10), 86400).select("event_id", "ts")


@query(f"SELECT date_trunc('hour', ts) AS bucket_start, bit_or((1 << slot)::INT) AS anchor_bits FROM (SELECT ts, {SLOT} AS slot FROM events) WHERE slot IS NOT NULL GROUP BY 1")
def hist_anchor_bits(spark, d):
    return histogram.anchor_bits(anchored(events(spark, d)), "ts", "slot", 3600)


@query(f"SELECT date_trunc('day', ts) AS bucket_start, min(event_id) AS first_row, min(CASE WHEN slot IS NOT NULL THEN event_id END) AS first_anchored FROM (SELECT *, {SLOT} AS slot FROM events) GROUP BY 1")
def hist_first_rows(spark, d):
    return histogram.first_rows(anchored(events(spark, d)).withColumn("a", F.col("slot").isNotNull()), "ts", "event_id", 86400, "a")


_RAIL = f"""WITH p AS (SELECT *, {_SQL_RANK} AS lvl, {SLOT} AS slot, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) - 1 AS pos, count(*) OVER () AS m FROM events),
r AS (SELECT pos * 100 // m AS slice, {_SQL_COUNTS}, count(*) FILTER (value > 100) AS matches, coalesce(bit_or((1 << slot)::INT), 0) AS anchor_bits FROM p GROUP BY 1)"""


@query(_RAIL + " SELECT * FROM r")
def rail_100(spark, d):
    ev = anchored(events(spark, d))
    return histogram.rail(ev, sorting.order_by(ev, "value", row_id="event_id"), 100, "event_type", MAPPING, F.col("value") > 100, "slot")


@query(_RAIL + """ SELECT slice, total, CASE greatest(trace, debug, info, warn, error, fatal) WHEN 0 THEN NULL WHEN fatal THEN 'Fatal' WHEN error THEN 'Error' WHEN warn THEN 'Warn' WHEN info THEN 'Info' WHEN debug THEN 'Debug' ELSE 'Trace' END AS dominant FROM r""")
def rail_dominant(spark, d):
    return histogram.dominant_level(rail_100(spark, d)).select("slice", "total", "dominant")


@query("SELECT count(*) FILTER (value > 100) AS matches, count(*) AS rows FROM events")
def match_counts(spark, d):
    return histogram.match_counts(events(spark, d), F.col("value") > 100)


# filters


def _filtered(spark, d, rule, name="events", columns=("event_id",)):
    return filters.where(load(spark, d, name), rule).select(*columns)


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def f_enum_in(spark, d):
    return _filtered(spark, d, filters.enum_in("event_type", ["error", "purchase"]))


@query(f"SELECT event_id FROM {_EV} WHERE lvl IN (3, 4)")
def f_level_in(spark, d):
    return _filtered(spark, d, filters.level_in("event_type", ["Error", "warning"], MAPPING))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'")
def f_time_range(spark, d):
    return _filtered(spark, d, filters.time_range("ts", datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 7, 12)))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25' ")
def f_time_after(spark, d):
    return _filtered(spark, d, filters.later_than("ts", datetime.datetime(2024, 1, 25)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12.5")
def f_number_range(spark, d):
    return _filtered(spark, d, filters.number_range("l_quantity", 10, 12.5), "lineitem", ("l_orderkey", "l_linenumber"))


@query("SELECT event_id FROM events WHERE value > 150.5")
def f_number_open(spark, d):
    return _filtered(spark, d, filters.greater("value", 150.5))


@query("SELECT event_id FROM events WHERE value > 50")
def f_boolean(spark, d):
    return filters.where(events(spark, d).withColumn("big", F.col("value") > 50), filters.is_boolean("big")).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def f_exactly(spark, d):
    return _filtered(spark, d, filters.exactly("event_type", "click"))


@query("SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 'tion th')")
def f_contains(spark, d):
    return _filtered(spark, d, filters.contains("text", "tion th"), "documents", ("doc_id",))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(m|blog)\\.[a-z]+\\.example')")
def f_regex(spark, d):
    return _filtered(spark, d, filters.matches("url", r"^https?://(m|blog)\.[a-z]+\.example"), "pages", ("page_id",))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^http[^/]*://[^/]*\\.example\\.org/en/[0-9][^/]*$')")
def f_wildcard(spark, d):
    return _filtered(spark, d, filters.wildcard("url", "http*://*.example.org/en/[0-9]*"), "pages", ("page_id",))


@query("SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END > 50, false)")
def f_not_null_semantics(spark, d):
    ev = events(spark, d).withColumn("holed", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return filters.where(ev, filters.negate(filters.greater("holed", 50))).select("event_id")


@query("SELECT event_id FROM events WHERE (event_type = 'error' OR value > 200) AND NOT (user_id BETWEEN 0 AND 5)")
def f_tree(spark, d):
    rule = filters.all_of(filters.any_of(filters.enum_in("event_type", ["error"]), filters.greater("value", 200)), filters.negate(filters.number_range("user_id", 0, 5)))
    return _filtered(spark, d, rule)


@query("SELECT event_id FROM events WHERE value < 10")
def f_absent_leaf(spark, d):
    return _filtered(spark, d, filters.all_of(filters.enum_in("no_such_column", ["x"]), filters.negate(filters.level_in("event_type", ["nothing"])), filters.less("value", 10)))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view') AND user_id = 7")
def f_in_lists(spark, d):
    return _filtered(spark, d, filters.all_of(filters.not_in("event_type", ["click", "view"]), filters.in_list("user_id", [7])))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01'")
def f_in_ranges(spark, d):
    return _filtered(spark, d, filters.all_of(filters.in_range("o_totalprice", 100000, 120000), filters.in_range("o_orderdate", datetime.datetime(1997, 1, 1), datetime.datetime(1998, 1, 1))), "orders", ("o_orderkey",))


@query("SELECT event_id FROM events WHERE length(props) = 9")
def f_custom(spark, d):
    return _filtered(spark, d, filters.custom("props", lambda c: F.length(c) == 9))


# sorts: the place in the order is part of the result


def _places(df, columns, **by):
    return sorting.positions(df, sorting.order_by(df, **by), keep=list(columns)).select("position", *columns)


@query(f"SELECT row_number() OVER (ORDER BY lvl DESC NULLS FIRST, event_id) - 1 AS position, event_id FROM {_EV}")
def s_level_desc(spark, d):
    return _places(events(spark, d), ["event_id"], column="event_type", descending=True, row_id="event_id", kind="level", mapping=MAPPING)


@query("SELECT row_number() OVER (ORDER BY CASE WHEN event_id % 5 <> 0 THEN value END ASC NULLS LAST, event_id) - 1 AS position, event_id FROM events")
def s_number_tail(spark, d):
    ev = events(spark, d).withColumn("holed", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return _places(ev, ["event_id"], column="holed", row_id="event_id")


@query("SELECT row_number() OVER (ORDER BY event_type DESC NULLS FIRST, event_id) - 1 AS position, event_id FROM events")
def s_enum_desc(spark, d):
    return _places(events(spark, d), ["event_id"], column="event_type", descending=True, row_id="event_id", kind="enum")


@query("SELECT row_number() OVER (ORDER BY ts ASC NULLS LAST, event_id) - 1 AS position, event_id FROM events")
def s_time(spark, d):
    return _places(events(spark, d), ["event_id"], column="ts", row_id="event_id")


@query("SELECT row_number() OVER (ORDER BY value > 50 DESC NULLS FIRST, event_id) - 1 AS position, event_id FROM events")
def s_boolean_desc(spark, d):
    return _places(events(spark, d).withColumn("big", F.col("value") > 50), ["event_id"], column="big", descending=True, row_id="event_id")


@query("SELECT row_number() OVER (ORDER BY trunc(value)::BIGINT, event_id) - 1 AS position, event_id FROM events")
def s_integer(spark, d):
    return _places(events(spark, d).withColumn("whole", F.floor("value")), ["event_id"], column="whole", row_id="event_id", kind="integer")


@query("SELECT row_number() OVER (ORDER BY props, event_id) - 1 AS position, event_id FROM events")
def s_text(spark, d):
    return _places(events(spark, d), ["event_id"], column="props", row_id="event_id", kind="text")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def s_newest_first(spark, d):
    return sorting.newest_first(events(spark, d), "event_id").limit(50).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id = 499")
def goto_line(spark, d):
    return sorting.goto_line(events(spark, d), 500, "event_id").select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE contains(props, '77') ORDER BY event_id LIMIT 5")
def find_first(spark, d):
    return annotate.find(events(spark, d), "77", columns=["props"], first=5, row_id="event_id").select("event_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def retention_last_n(spark, d):
    return sorting.last_lines(events(spark, d), 20, "event_type", "event_id").select("event_type", "event_id")


# joins, navigation, annotation


@query(f"SELECT event_id, slot AS colour, CASE WHEN slot IS NOT NULL THEN 'note ' || event_id END AS note FROM (SELECT *, {SLOT} AS slot FROM events)")
def with_anchors(spark, d):
    ev = events(spark, d).select(F.lit("events").alias("source"), F.col("event_id").alias("line_id"))
    marks = anchored(events(spark, d)).where("slot IS NOT NULL").select(F.lit("events").alias("source"), F.col("event_id").alias("line_id"), F.col("slot").alias("colour"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    return annotate.with_anchors(ev, marks).select(F.col("line_id").alias("event_id"), "colour", "note")


@query("""SELECT event_id AS line_id, CASE WHEN event_id % 3 = 1 THEN 7 WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS colour, CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 1 THEN 'new' WHEN event_id % 2 = 0 THEN 'old' END AS note
FROM events WHERE (event_id % 2 = 0 OR event_id % 5 = 0 OR event_id % 3 = 1) AND event_id % 11 <> 0""")
def upsert_anchors(spark, d):
    ids = events(spark, d).select(F.lit("events").alias("source"), F.col("event_id").alias("line_id"))
    anchors = ids.where("line_id % 2 = 0").select("*", F.lit(1).alias("colour"), F.lit("old").alias("note"))
    change = lambda cond, seq, action, colour, note: ids.where(cond).select("*", F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(colour).alias("colour"), F.lit(note).cast("string").alias("note"))
    changes = change("line_id % 5 = 0", 1, "set", 2, " new ").unionByName(change("line_id % 3 = 1", 2, "recolour", 99, None)).unionByName(change("line_id % 11 = 0", 3, "remove", 0, None))
    return annotate.upsert_anchors(anchors, changes).select("line_id", "colour", "note")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-12 08:00:00' ORDER BY ts, event_id LIMIT 1")
def asof_goto(spark, d):
    return navigate.goto_time(events(spark, d), "ts", datetime.datetime(2024, 1, 12, 8), "event_id").select("event_id", "ts")


@query("""SELECT o.o_orderkey, e.ts AS found_ts, e.event_id AS found_row FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_microseconds((o_orderkey * 7919 % 2764800)::BIGINT * 1000000) AS target_ts FROM orders) o
ASOF LEFT JOIN (SELECT ts, min(event_id) AS event_id FROM events GROUP BY ts) e ON o.target_ts <= e.ts""")
def asof_many(spark, d):
    asks = load(spark, d, "orders").select("o_orderkey", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 2764800).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("target_ts"))
    return navigate.asof_rows(events(spark, d), "ts", asks, row_id="event_id").select("o_orderkey", "found_ts", "found_row")


@query(f"""WITH m AS (SELECT event_id, CASE WHEN {SLOT} IS NOT NULL THEN event_id END AS own FROM events)
SELECT event_id, coalesce(min(own) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(own) OVER ()) AS next_marked,
coalesce(max(own) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(own) OVER ()) AS previous_marked FROM m""")
def next_anchor(spark, d):
    return navigate.next_marked(anchored(events(spark, d)), "event_id", F.col("slot").isNotNull()).select("event_id", "next_marked", "previous_marked")


@query("""SELECT event_id, row_number() OVER (ORDER BY event_id) AS hit_number, coalesce(lead(event_id) OVER (ORDER BY event_id), min(event_id) OVER ()) AS next_hit FROM events WHERE contains(props, '7')""")
def find_hits(spark, d):
    return navigate.hit_positions(events(spark, d), "event_id", F.col("props").contains("7")).select("event_id", "hit_number", "next_hit")


@query("SELECT event_id FROM events WHERE contains(event_type, 'err') OR contains(props, 'err')")
def find_columns(spark, d):
    return annotate.find(events(spark, d), "err", columns=["event_type", "props"]).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'bad' WHEN value > 100 THEN 'large' WHEN event_type IN ('error', 'purchase') THEN 'watch' END AS highlight FROM events")
def highlight_last_wins(spark, d):
    return annotate.highlight(events(spark, d), RULES).select("event_id", "highlight")


RULES = [
    ("watch", filters.enum_in("event_type", ["error", "purchase"])),
    ("large", filters.greater("value", 100)),
    ("gone", filters.enum_in("no_such_column", ["x"])),
    ("bad", filters.all_of(filters.enum_in("event_type", ["error"]), filters.greater("value", 100))),
]


@query("""SELECT 'watch' AS rule, true AS active, count(*) FILTER (event_type IN ('error', 'purchase')) AS rows_marked FROM events UNION ALL SELECT 'large', true, count(*) FILTER (value > 100) FROM events
UNION ALL SELECT 'gone', false, 0 UNION ALL SELECT 'bad', true, count(*) FILTER (event_type = 'error' AND value > 100) FROM events""")
def inactive_rules(spark, d):
    return annotate.inactive_rules(events(spark, d), RULES)


@query("""SELECT event_id, 0 AS place, 'event_type' AS field, event_type AS value FROM events UNION ALL SELECT event_id, 1, 'user_id', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 2, 'props', props FROM events""")
def record_detail(spark, d):
    return annotate.record_detail(events(spark, d), "event_id", ["event_type", "user_id", "props"])


# schema and profile


def _parsed(df: DataFrame) -> DataFrame:
    """JSON lines of a table, parsed again, as many tasks: a small file would be one."""
    named = lines.spread(df, "event_id").select(F.lit("events").alias("source"), F.col("event_id").alias("line_id"), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", F.col("event_type").alias("level"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("raw"))
    return formats.parse_jsonl(named)


@query("""SELECT * FROM (VALUES ('k'), ('level'), ('ts'), ('user_id'), ('value')) v(key), (SELECT count(*) AS rows FROM events)""")
def discover_columns(spark, d):
    return schema.discover(_parsed(events(spark, d))).select("key", "rows")


@query("SELECT event_id, ts, user_id, event_type AS level, value, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_typed(spark, d):
    out = schema.apply_schema(_parsed(events(spark, d)), schema.LogSchema([schema.Field("ts", ["ts"], "time"), schema.Field("user_id", ["user_id"], "integer"), schema.Field("level", ["level"], "enum"), schema.Field("value", ["value"], "floating"), schema.Field("k", ["k"], "integer")]))
    return out.select(F.col("line_id").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("user_id"), "level", "value", F.col("k").cast("long").alias("k"))


@query("""SELECT * FROM (VALUES ('ts', 'time'), ('level', 'enum'), ('k', 'integer'), ('user_id', 'integer'), ('value', 'floating')) v(key, type)""")
def inferred_types(spark, d):
    return schema.promote(schema.profile(_parsed(events(spark, d)))).select("key", "type")


@query("""SELECT 'user_id' AS "column", count(*) AS total, count(user_id) AS present, count(user_id) AS matching, 0.0 AS mismatch_pct FROM events
UNION ALL SELECT 'k', count(*), count(*), count(*) FILTER (json_extract(props, '$.k')::BIGINT % 10 <> 0), round(100.0 * count(*) FILTER (json_extract(props, '$.k')::BIGINT % 10 = 0) / count(*), 4) FROM events""")
def health_report(spark, d):
    k = F.get_json_object("props", "$.k")
    ev = events(spark, d).withColumn("k", F.when(k.cast("long") % 10 == 0, F.concat(k, F.lit("x"))).otherwise(k))
    return schema.type_health(ev, {"user_id": "integer", "k": "integer"})


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def distinct_values(spark, d):
    return schema.distinct_values(load(spark, d, "orders"), "o_orderpriority")


@query("SELECT min(value) AS min_value, max(value) AS max_value, min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def min_max(spark, d):
    return schema.min_max(events(spark, d), "value", "ts")


@query("SELECT event_type, coalesce(bool_and(ok), true) AS monotonic FROM (SELECT event_type, ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS ok FROM events) GROUP BY 1")
def monotonic(spark, d):
    return schema.is_monotonic(events(spark, d), "ts", "event_id", "event_type")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, user_id::VARCHAR) AS first_alias FROM events")
def alias_columns(spark, d):
    made = F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("b"), F.col("user_id").cast("string"))
    return events(spark, d).withColumn("fields", made).select("event_id", schema.value_of(schema.Field("x", ["missing", "a", "b"])).alias("first_alias"))


@query(f"SELECT event_type, lvl AS rank, CASE lvl WHEN 0 THEN 'Trace' WHEN 1 THEN 'Debug' WHEN 2 THEN 'Info' WHEN 3 THEN 'Warn' WHEN 4 THEN 'Error' END AS name, count(*) AS rows FROM {_EV} GROUP BY ALL")
def level_names(spark, d):
    rank = levels.level_rank(F.col("event_type"), MAPPING)
    return events(spark, d).groupBy("event_type", rank.alias("rank"), levels.level_name(rank).alias("name")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, strftime(make_timestamp((epoch_us(ts) + 500) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS shown FROM events")
def format_times(spark, d):
    return events(spark, d).select("event_id", times.format_time(F.col("ts")).alias("shown"))


@query("SELECT event_id, ts AS parsed FROM events")
def parse_times(spark, d):
    ev = events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSSSSS").alias("t"))
    return ev.select("event_id", times.parse_time(F.col("t")).cast("timestamp_ntz").alias("parsed"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'string' WHEN 3 THEN 'bool' WHEN 4 THEN 'string' ELSE 'null' END AS kind FROM events""")
def scalar_kinds(spark, d):
    made = F.element_at(F.array(F.col("user_id").cast("string"), F.lit("1.5e3"), F.lit(" 42"), F.lit("true"), F.lit("1d"), F.lit("")), (F.col("event_id") % 6 + 1).cast("int"))
    return events(spark, d).select("event_id", text.scalar_kind(made).alias("kind"))


# formats: rendered from the tables, then read again


@query("SELECT event_id, event_type, props, user_id FROM events")
def logfmt_roundtrip(spark, d):
    rendered = export.to_logfmt_lines(events(spark, d), ["event_id", "event_type", "props", "user_id"]).select(F.lit("e").alias("source"), F.lit(0).cast("long").alias("line_id"), F.col("value").alias("raw"))
    f = formats.parse_logfmt(rendered).select("fields")
    get = lambda k: F.col("fields")[k]
    return f.select(get("event_id").cast("long").alias("event_id"), get("event_type").alias("event_type"), get("props").alias("props"), get("user_id").cast("long").alias("user_id"))


@query("SELECT event_id, event_type, props, value FROM events")
def csv_roundtrip(spark, d):
    columns = ["event_id", "event_type", "props", "value"]
    rows = export.to_csv_lines(events(spark, d), columns).select(F.monotonically_increasing_id().alias("n"), "value")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit(export.csv_header(columns)).alias("value"))
    f = formats.parse_csv(head.unionByName(rows).select(F.lit("e").alias("source"), F.col("n").alias("line_id"), F.col("value").alias("raw"))).where("error IS NULL")
    get = lambda k: F.col("fields")[k]
    return f.select(get("event_id").cast("long").alias("event_id"), get("event_type").alias("event_type"), get("props").alias("props"), get("value").cast("double").alias("value"))


@query("SELECT event_id, 'u' || user_id AS auth, 'GET' AS verb, '/' || event_type AS request, 200 AS response, date_trunc('second', ts) AS at FROM events WHERE event_id % 10 <> 0")
def regex_clf(spark, d):
    t = next(t for t in templates.BUILT_IN if t.name == "Apache/nginx Common Log Format")
    clf = F.format_string("10.0.0.1 - u%d [%s +0000] \"GET /%s HTTP/1.1\" 200 %d", "user_id", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type", "event_id")
    raw = events(spark, d).select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.when(F.col("event_id") % 10 == 0, "broken line").otherwise(clf).alias("raw"))
    f = formats.parse_regex(raw, t).where("error IS NULL")
    get = lambda k: F.col("fields")[k]
    return f.select(F.col("line_id").alias("event_id"), get("auth").alias("auth"), get("verb").alias("verb"), get("request").alias("request"), get("response").cast("int").alias("response"), times.parse_time(get("timestamp")).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id AS line_id, 'Error on line ' || (event_id + 1) || ': not a JSON object' AS error FROM events WHERE event_id % 10 = 0")
def parse_errors(spark, d):
    raw = events(spark, d).select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.when(F.col("event_id") % 10 == 0, "[1, 2]").otherwise(F.col("props")).alias("raw"))
    return formats.errors(formats.parse_jsonl(raw)).select("line_id", "error")


def _numbered_text(spark, d):
    """Lines of conversations: each turn's lines, the second and later ones indented."""
    c = load(spark, d, "conversations")
    return c.select(F.format_string("c%d", "conv_id").alias("source"), "turn", F.posexplode(F.split("text", "\n")).alias("i", "t")).select("source", (F.col("turn") * 1000 + F.col("i")).alias("line_id"), F.when(F.col("i") == 0, F.concat(F.lit(">"), F.col("t"))).otherwise(F.concat(F.lit(" "), F.col("t"))).alias("raw"))


@query("SELECT 'c' || conv_id AS source, turn * 1000 AS line_id, '>' || replace(regexp_replace(text, '\\n+$', ''), chr(10), chr(10) || ' ') AS raw FROM conversations")
def fold_indented(spark, d):
    return folding.fold_indented(_numbered_text(spark, d))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS record_id FROM conversations")
def record_numbers(spark, d):
    rows = _numbered_text(spark, d)
    out = folding.number_records(rows, F.col("raw").startswith(">"), block=1500)
    return out.where(F.col("raw").startswith(">")).select(F.substring("source", 2, 20).cast("long").alias("conv_id"), F.floor(F.col("line_id") / 1000).alias("turn"), "record_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_id FROM conversations")
def line_ids(spark, d):
    c = load(spark, d, "conversations").withColumn("block", F.floor(F.col("turn") / 3))
    return lines.number_within(c, ["conv_id"], ["block"], ["turn"], "line_id").select("conv_id", "turn", "line_id")


@query("""SELECT 'j' || (page_id % 4) AS source, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' WHEN 2 THEN 'csv' ELSE 'regex' END AS format FROM pages WHERE page_id < 4""")
def detect_formats(spark, d):
    p = load(spark, d, "pages").withColumn("k", F.col("page_id") % 4)
    raw = F.when(F.col("k") == 0, F.to_json(F.struct("page_id", "url"))).when(F.col("k") == 1, F.format_string("id=%d url=%s", "page_id", F.concat(F.lit('"'), F.col("url"), F.lit('"')))).when(F.col("k") == 2, F.format_string("%d,%s", F.col("page_id"), F.substring_index("url", "?", 1))).otherwise(F.format_string("2024-04-28T04:02:03.123Z stdout F page %d", "page_id"))
    return detect.detect_formats(p.select(F.concat(F.lit("j"), F.col("k").cast("string")).alias("source"), F.floor(F.col("page_id") / 4).alias("line_id"), raw.alias("raw"))).select("source", "format")


@query("""SELECT page_id, '/logs/app' || (page_id % 3) || '.log' AS rotation_family, CASE page_id % 4 WHEN 0 THEN 4611686018427387904 WHEN 1 THEN 1000000000 - (page_id + 1) WHEN 2 THEN date_diff('day', DATE '1970-01-01', DATE '2024-01-01' + page_id::INT) ELSE date_diff('day', DATE '1970-01-01', DATE '2023-01-01' + page_id::INT) END::BIGINT AS rotation_rank FROM pages""")
def rotation_order(spark, d):
    p = load(spark, d, "pages")
    app = F.format_string("/logs/app%d", F.col("page_id") % 3)
    day = lambda start: F.date_format(F.date_add(F.lit(start).cast("date"), F.col("page_id").cast("int")), "yyyy-MM-dd")
    name = F.when(F.col("page_id") % 4 == 0, F.concat(app, F.lit(".log"))).when(F.col("page_id") % 4 == 1, F.concat(app, F.lit(".log."), (F.col("page_id") + 1).cast("string"), F.lit(".gz"))).when(F.col("page_id") % 4 == 2, F.concat(app, F.lit(".log-"), day("2024-01-01"))).otherwise(F.concat(app, F.lit("-"), day("2023-01-01"), F.lit(".log.zst")))
    return lines.rotation_order(p.withColumn("source", name)).select("page_id", "rotation_family", "rotation_rank")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS kind, 0 AS source_rank FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_type, 1 FROM part")
def merge_sources(spark, d):
    a = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return lines.merge_sources(a, b).select("key", "name", "balance", "kind", "source_rank")


# exports


@query("""SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}' AS value FROM events""")
def export_jsonl(spark, d):
    return export.to_json_lines(events(spark, d), ["event_id", "ts", "event_type", "props"])


@query("""SELECT event_id || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ',' || event_type || ',"' || replace(props, '"', '""') || '"' AS value FROM events""")
def export_csv(spark, d):
    return export.to_csv_lines(events(spark, d), ["event_id", "ts", "event_type", "props"])


@query("""SELECT -2 AS position, '| event_id | event_type | props |' AS value UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT event_id, '| ' || event_id || ' | ' || event_type || ' | ' || props || ' |' FROM events""")
def export_markdown(spark, d):
    return export.to_markdown_lines(events(spark, d), "event_id", ["event_id", "event_type", "props"])


@query("SELECT event_id || ' ' || event_type || ' ' || user_id AS value FROM events")
def export_plain(spark, d):
    return export.to_plain_lines(events(spark, d), ["event_id", "event_type", "user_id"])


# time gaps, clusters, differences, offsets


@query("""SELECT (epoch_us(ts) - epoch_us(p)) / 1e6 AS gap_seconds, pid AS row_before, event_id AS row_after, p AS ts_before, ts AS ts_after FROM (SELECT *, lag(ts) OVER o AS p, lag(event_id) OVER o AS pid FROM events WINDOW o AS (ORDER BY ts, event_id)) WHERE p IS NOT NULL ORDER BY 1 DESC, 3 LIMIT 10""")
def time_gaps(spark, d):
    return patterns.time_gaps(events(spark, d), "ts", "event_id")


@query("SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b', '<uuid>', 'g'), '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b', '<ip>', 'g'), '\\b0[xX][0-9a-fA-F]+\\b', '<hex>', 'g'), '\\d+(?:\\.\\d+)?', '<n>', 'g') AS template, count(*) AS rows FROM pages GROUP BY 1")
def cluster_templates(spark, d):
    return patterns.cluster_messages(load(spark, d, "pages"), "url")


@query("""WITH t AS (SELECT page_id % 2 AS side, regexp_replace(url, '\\d+(?:\\.\\d+)?', '<n>', 'g') AS template FROM pages) SELECT template, count(*) FILTER (side = 0) AS left_rows, count(*) FILTER (side = 1) AS right_rows FROM t GROUP BY 1 HAVING count(*) FILTER (side = 0) <> count(*) FILTER (side = 1)""")
def diff_templates(spark, d):
    p = load(spark, d, "pages")
    return patterns.diff_templates(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), "url")


@query("SELECT event_id, ts + to_seconds(CASE event_type WHEN 'error' THEN 90 WHEN 'view' THEN -30 ELSE 0 END) AS ts FROM events")
def timeshift(spark, d):
    offsets = spark.createDataFrame([("error", 90.0), ("view", -30.0)], "event_type string, offset_seconds double")
    return patterns.timeshift(events(spark, d), "ts", offsets, "event_type").select("event_id", "ts")
