"""Time gaps, message clusters, differences of two sources, clock offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scratch import written
from logloom.operators.navigate import BLOCK_ROWS, time_blocks

#: What a mined template has at a place whose word varies.
ANY = "<*>"
SHARE, VARIANTS, BROADCAST_PAIRS = 0.001, 8, 1_000_000


def time_gaps(df: DataFrame, ts: str, row_id: str, n: int = 10, seconds: int = 86400, block: int = BLOCK_ROWS) -> DataFrame:
    """The n longest silences: gap_seconds, row and time before and after. Neighbours are found inside time buckets; a
    bucket's first row follows the last row of the bucket with rows before it."""
    rows = time_blocks(df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("at"), F.col(row_id).alias("row")), "at", seconds, block=block).withColumnRenamed("_b", "b")
    inside = Window.partitionBy("b").orderBy("at", "row")
    last = rows.groupBy("b").agg(F.max(F.struct("at", "row")).alias("last"))
    # one row a bucket
    before = last.withColumn("prev", F.lag("last").over(Window.orderBy("b"))).select(F.col("b").alias("pb"), "prev")
    own = F.lag(F.struct("at", "row")).over(inside)
    near = rows.withColumn("own", own).join(before, F.col("b") == F.col("pb")).withColumn("p", F.coalesce("own", "prev")).where("p IS NOT NULL")
    gap = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("p.at").cast("timestamp"))) / 1e6
    return near.select(gap.alias("gap_seconds"), F.col("p.row").alias("row_before"), F.col("row").alias("row_after"), F.col("p.at").alias("ts_before"), F.col("at").alias("ts_after")).orderBy(F.desc("gap_seconds"), "row_after").limit(n)


def message_template(text: Column) -> Column:
    """The text with times, UUIDs, addresses, hexadecimal and decimal numbers masked."""
    out = text
    for pattern, mask in (
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z\b|[+-]\d{2}:?\d{2}\b)?", "<time>"),
        (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<time>"),
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
        (r"\b0[xX][0-9a-fA-F]+\b", "<hex>"),
        (r"\d+(?:\.\d+)?", "<n>"),
    ):
        out = F.regexp_replace(out, pattern, mask)
    return out


def cluster_messages(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(message_template(F.col(column)).alias("template")).agg(F.count(F.lit(1)).alias("rows"))


def diff_templates(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """template, left_rows, right_rows of messages whose counts differ."""
    a, b = cluster_messages(left, column).withColumnRenamed("rows", "left_rows"), cluster_messages(right, column).withColumnRenamed("rows", "right_rows")
    return a.join(b, "template", "full").select("template", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows")).where("left_rows <> right_rows")


def _mined(texts: DataFrame, counts: list[str], share: float, variants: int) -> DataFrame:
    """template and the sums of the counts, for masked texts (column template) that come once each."""
    texts = written(texts, "texts")
    every = sum((F.col(c) for c in counts), F.lit(0))
    need = F.greatest(F.lit(2), F.ceil(F.lit(share) * F.lit(texts.agg(F.sum(every)).first()[0] or 0)))
    split = texts.select(F.sha2("template", 256).alias("id"), *counts, F.split("template", " ").alias("ws"))
    words = split.select("id", *counts, F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    frequent = written(words.groupBy("n", "i", "w").agg(F.sum(every).alias("c")).where(F.col("c") >= need).select("n", "i", "w", F.lit(True).alias("known")), "words")
    if frequent.count() <= BROADCAST_PAIRS:
        frequent = F.broadcast(frequent)
    keyed = words.join(frequent, ["n", "i", "w"], "left").withColumn("w", F.when(F.col("known"), F.col("w")).otherwise(ANY))
    lines = keyed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda p: p["w"]).alias("ws"), *(F.first(c).alias(c) for c in counts))
    # a template is known by the parity of its words' hashes, so that it can be had without one of them
    hashes = [F.xxhash64(F.lit(seed), F.col("i"), F.col("w")) for seed in (1, 2)]
    kinds = lines.groupBy("ws").agg(*(F.sum(c).alias(c) for c in counts))
    parity = lambda each: F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    kinds = kinds.withColumn("a", parity(F.transform("ws", lambda w, i: F.xxhash64(F.lit(1), i, w)))).withColumn("b", parity(F.transform("ws", lambda w, i: F.xxhash64(F.lit(2), i, w))))
    kinds = written(kinds, "kinds")
    places = kinds.select("a", "b", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w")).where(F.col("w") != ANY)
    places = places.select("a", "b", "n", "i", F.col("a").bitwiseXOR(hashes[0]).alias("x"), F.col("b").bitwiseXOR(hashes[1]).alias("y"))
    varying = places.groupBy("n", "i", "x", "y").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= variants).drop("k")
    masks = places.join(varying, ["n", "i", "x", "y"]).groupBy("a", "b").agg(F.collect_set("i").alias("vary"))
    masked = F.transform("ws", lambda w, i: F.when(F.array_contains("vary", i), ANY).otherwise(w))
    told = kinds.join(masks, ["a", "b"], "left").select(F.array_join(F.when(F.col("vary").isNull(), F.col("ws")).otherwise(masked), " ").alias("template"), *counts)
    return told.groupBy("template").agg(*(F.sum(c).alias(c) for c in counts))


def mine_messages(df: DataFrame, column: str, share: float = SHARE, variants: int = VARIANTS) -> DataFrame:
    """template, rows: similar messages as one, words that vary as <*>. Null messages are skipped.

    Numbers, addresses and the like are masked first, and equal texts counted together. A word (what blanks part) stays if `share` of all
    messages, and two at least, have it at its place in a text of as many words. Then a place varies, too, if the templates that
    are the same but for it have `variants` words or more there: names that are frequent, each of them."""
    return _mined(cluster_messages(df, column), ["rows"], share, variants)


def diff_mined(left: DataFrame, right: DataFrame, column: str, share: float = SHARE, variants: int = VARIANTS) -> DataFrame:
    """template, left_rows, right_rows where these differ; the templates are mined from both sides together."""
    sides = left.select(column, F.lit(1).alias("_l")).unionByName(right.select(column, F.lit(0).alias("_l"))).where(F.col(column).isNotNull())
    texts = sides.groupBy(message_template(F.col(column)).alias("template")).agg(F.sum("_l").alias("left_rows"), F.sum(1 - F.col("_l")).alias("right_rows"))
    return _mined(texts, ["left_rows", "right_rows"], share, variants).where("left_rows <> right_rows")


def timeshift(df: DataFrame, ts: str, offsets: DataFrame, by: str) -> DataFrame:
    """Adds each source's clock offset (column offset_seconds of a small table) to its times; no offset is 0."""
    few = offsets.select(F.col(by), "offset_seconds")
    shift = F.make_dt_interval(secs=F.coalesce("offset_seconds", F.lit(0)).cast("decimal(18,6)"))
    return df.join(few, by, "left").withColumn(ts, F.col(ts) + shift).drop("offset_seconds")
