"""Registered queries that run a stream over a table's file until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.scratch import scratch
from logloom.operators import annotate, filters, schema
from logloom.plans import catalogue
from logloom.plans.catalogue import MAPPING, RULES, query
from logloom.streaming import stream


def events(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(fields).option("pathGlobFilter", "events.parquet").parquet(d)


def collected(spark: SparkSession, source: DataFrame, merge, mode: str = "append") -> DataFrame:
    sink = stream.Merged(spark, scratch(spark, "merged"), merge)
    stream.drain(source, sink, mode)
    return sink.table()


def added(spark: SparkSession, source: DataFrame, timers: bool = False) -> DataFrame:
    path = scratch(spark, "added")
    stream.drain(source, stream.appending(path), timers=timers)
    return stream.appended(spark, path)


@query(catalogue.ORACLES["hist_1h_levels"])
def stream_histogram(spark, d):
    out = collected(spark, stream.stream_histogram(events(spark, d), "ts", "event_type", 3600, MAPPING), stream.merge_buckets, "update")
    return out.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND value > 100")
def stream_filter(spark, d):
    rule = filters.all_of(filters.enum_in("event_type", ["error"]), filters.greater("value", 100))
    return added(spark, filters.where(events(spark, d), rule).select("event_id"))


@query(catalogue.ORACLES["highlight_last_wins"])
def stream_highlight(spark, d):
    return added(spark, annotate.highlight(events(spark, d), RULES).select("event_id", "highlight"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def stream_retention(spark, d):
    return collected(spark, events(spark, d).select("event_id", "event_type"), stream.retain_last(1000, "event_id"))


@query("SELECT event_type, max(ts) AS last_ts, coalesce(bool_and(ok), true) AS monotonic FROM (SELECT event_type, ts, ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS ok FROM events) GROUP BY 1")
def stream_monotonic(spark, d):
    return collected(spark, events(spark, d).select("event_id", "event_type", "ts"), stream.merge_order("ts", "event_id", "event_type"))


@query("SELECT event_id AS row_id, 'Error on line ' || (event_id + 1) || ': not a JSON object' AS error FROM events WHERE event_id % 50 = 0 ORDER BY event_id DESC LIMIT 1000")
def stream_errors(spark, d):
    from logloom.sources import formats

    raw = events(spark, d).select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 50 == 0, "no object").otherwise(F.col("props")).alias("raw"))
    return collected(spark, formats.parse_jsonl(raw).select("row_id", "error"), stream.recent_errors())


@query("SELECT 'k' AS key, count(*) AS rows, 'integer' AS type FROM events")
def stream_profile(spark, d):
    from logloom.sources import formats

    raw = events(spark, d).select(F.lit("e").alias("source"), F.col("event_id").alias("line_id"), F.col("props").alias("raw"))
    return schema.promote(collected(spark, formats.parse_jsonl(raw), stream.merge_profile)).select("key", "rows", "type")


@query("SELECT 'u' || user_id AS source, count(*) - 1 AS records FROM (SELECT user_id FROM events WHERE event_type <> 'view') GROUP BY 1 HAVING count(*) > 1")
def stream_fold(spark, d):
    """Every row that is no view is a header, views continue it; a source's last record is still pending."""
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("  at "), F.col("props"))).otherwise(F.concat_ws(" ", "event_type", "props"))
    lines = events(spark, d).select(F.format_string("u%d", "user_id").alias("source"), F.col("event_id").alias("line_id"), raw.alias("raw"))
    return added(spark, stream.fold_stream(lines, r"\S", 3_600_000), timers=True).where("error IS NULL").groupBy("source").agg(F.count(F.lit(1)).alias("records"))
