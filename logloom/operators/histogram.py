"""Time by level histograms, their dense fill, and the overview rail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import levels
from logloom.operators.sorting import positions

#: Bucket widths in seconds. Fixed values.
RUNGS = (1, 10, 60, 600, 3600, 86400)
SLOTS = ("unknown", "trace", "debug", "info", "warn", "error", "fatal")


def auto_rung(low_micros: int | None, high_micros: int | None, budget: int = 500) -> int:
    """The finest width of which span / width + 1 buckets fit the budget; a day if none does."""
    if low_micros is None or high_micros is None or high_micros <= low_micros:
        return RUNGS[0] if budget > 0 else RUNGS[-1]
    return next((r for r in RUNGS if budget > 0 and (high_micros - low_micros) // (r * 1_000_000) + 1 <= budget), RUNGS[-1])


def span(df: DataFrame, ts: str) -> DataFrame:
    """Precise first and last time and the number of rows."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows"))


def choose_rung(df: DataFrame, ts: str, budget: int = 500) -> int:
    one = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    return auto_rung(one[0], one[1], budget)


def level_counts(rank: Column) -> list[Column]:
    """A count a level; rows of no level are unknown."""
    return [F.count_if(rank.isNull()).alias("unknown"), *(F.count_if(rank == i).alias(n.lower()) for i, n in enumerate(levels.CANONICAL)), F.count(F.lit(1)).alias("total")]


def histogram(df: DataFrame, ts: str, level: str, seconds: int | str = "auto", mapping: dict[str, str] | None = None, budget: int = 500, dense: bool = False) -> DataFrame:
    """bucket_start, a count for each level, total. Rows without a time are skipped. dense: buckets without rows too."""
    width = choose_rung(df, ts, budget) if seconds == "auto" else int(seconds)
    rows = df.where(F.col(ts).isNotNull())
    out = rows.groupBy(F.window(ts, f"{width} seconds")["start"].alias("bucket_start")).agg(*level_counts(levels.level_rank(F.col(level), mapping)))
    return fill(out, width) if dense else out


def fill(hist: DataFrame, seconds: int) -> DataFrame:
    """Rows of zeros for the buckets between the first and the last that have none."""
    ends = hist.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("bucket_start"))
    return every.join(hist, "bucket_start", "left").select("bucket_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in hist.columns if c != "bucket_start"))


def level_totals(hist: DataFrame, low=None, high=None) -> DataFrame:
    """Sums over the buckets from low to high, both included."""
    some = hist
    if low is not None:
        some = some.where(F.col("bucket_start") >= low)
    if high is not None:
        some = some.where(F.col("bucket_start") <= high)
    return some.agg(F.min("bucket_start").alias("first_bucket"), F.max("bucket_start").alias("last_bucket"), *(F.sum(c).alias(c) for c in (*SLOTS, "total")))


def bucket_bounds(hist: DataFrame, seconds: int) -> DataFrame:
    """Adds bucket_end, the last instant of the bucket."""
    return hist.withColumn("bucket_end", F.col("bucket_start") + F.expr(f"INTERVAL {seconds} SECONDS") - F.expr("INTERVAL 1 MICROSECOND"))


def rows_of_bucket(df: DataFrame, ts: str, start, seconds: int) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(start) + F.expr(f"INTERVAL {seconds} SECONDS")))


def anchor_bits(df: DataFrame, ts: str, slot: str, seconds: int) -> DataFrame:
    """bucket_start, anchor_bits: bit s is set if a row anchored in colour slot s (0 to 7) lies in the bucket."""
    rows = df.where(F.col(ts).isNotNull() & F.col(slot).isNotNull())
    return rows.groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("bucket_start")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(slot).cast("int"))).alias("anchor_bits"))


def first_rows(df: DataFrame, ts: str, row_id: str, seconds: int, anchored: str | None = None) -> DataFrame:
    """bucket_start, first_row and, if a flag column is given, first_anchored."""
    rows = df.where(F.col(ts).isNotNull())
    out = [F.min(row_id).alias("first_row")]
    if anchored:
        out.append(F.min(F.when(F.col(anchored), F.col(row_id))).alias("first_anchored"))
    return rows.groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("bucket_start")).agg(*out)


def rail(df: DataFrame, order: list[Column], slices: int, level: str, mapping: dict[str, str] | None = None, match: Column | None = None, slot: str | None = None) -> DataFrame:
    """The sorted rows in `slices` equal parts: slice, level counts, matches and anchor_bits."""
    told = {"_rank": levels.level_rank(F.col(level), mapping), "_match": F.lit(False) if match is None else match, "_slot": F.col(slot).cast("int") if slot else F.lit(None).cast("int")}
    placed = positions(df.withColumns(told), order, keep=list(told))
    m = placed.count()
    bits = F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_slot"))), F.lit(0))
    return placed.groupBy(F.floor(F.col("position") * slices / max(m, 1)).alias("slice")).agg(*level_counts(F.col("_rank")), (F.count_if("_match") if match is not None else F.lit(0)).alias("matches"), bits.alias("anchor_bits"))


def dominant_level(rail_df: DataFrame) -> DataFrame:
    """Adds dominant: the level with the most rows, of equals the more severe; null if none has a level."""
    named = [F.struct(F.col(n.lower()).alias("rows"), F.lit(i).alias("rank"), F.lit(n).alias("name")) for i, n in enumerate(levels.CANONICAL)]
    top = F.array_max(F.array(*named))
    return rail_df.withColumn("dominant", F.when(top["rows"] > 0, top["name"]))


def match_counts(df: DataFrame, match: Column) -> DataFrame:
    return df.agg(F.count_if(match).alias("matches"), F.count(F.lit(1)).alias("rows"))
