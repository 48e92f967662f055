"""Moving about sorted rows: as-of lookups, next marked rows, hit positions. No window spans all rows: neighbours are found
block by block, with the blocks' edges carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 65_536
#: Parts that the rows of a bucket are dealt into where they meet the bucket's count.
SALTS = 32


def goto_time(df: DataFrame, ts: str, at, row_id: str = "row_id") -> DataFrame:
    """The first row at or after a time."""
    return df.where(F.col(ts) >= F.lit(at)).orderBy(ts, row_id).limit(1)


def time_blocks(rows: DataFrame, ts: str, seconds: int, by: list[str] | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds _b, a number that never falls with the time: buckets of so many seconds, cut into equal parts where one holds more
    than `block` rows. The counts are one row a crowded bucket; where they are too many to be broadcast, a bucket's rows meet its count
    in SALTS tasks, dealt by what is in them."""
    by = by or []
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    whole = F.floor(at / (seconds * 1_000_000))
    rows = rows.withColumn("_whole", whole)
    counts = rows.groupBy(*by, "_whole").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("_whole").alias("_w"), F.least(F.ceil(F.col("_n") / block), F.lit(1 << 20)).alias("_parts"))
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
    counts = counts.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = (F.col("_whole") == F.col("_w")) & (F.col("_salt") == F.col("_s"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    parts = F.coalesce("_parts", F.lit(1))
    inside = F.floor((at - F.col("_whole") * (seconds * 1_000_000)) / (seconds * 1_000_000 / parts))
    return rows.join(counts, on, "left").withColumn("_b", F.col("_whole") * (1 << 20) + F.least(inside, parts - 1)).drop("_whole", "_w", "_parts", "_salt", "_s", *(f"_{k}" for k in by))


def asof_rows(df: DataFrame, ts: str, targets: DataFrame, target: str = "target_ts", row_id: str = "row_id", seconds: int = 3600, by: str | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """For each target: target columns, found_ts, found_row: the first row at or after it (null if there is none).

    Times are cut into buckets. Inside a bucket the row after each time that is asked for comes from one window over the bucket's
    times, latest first; where the bucket has none, from the first row of the next bucket that has any. `by` asks within
    equal keys. Of rows of the same time only the first takes part, and a time is asked for once, so a crowded instant is no
    crowded bucket; the targets get their answers back by their time.
    """
    key = [by] if by else []
    asked = targets.where(F.col(target).isNotNull()).select(*key, F.col(target).cast(df.schema[ts].dataType).alias("_t"), F.struct(*targets.columns).alias("_ask"))
    rows = df.where(F.col(ts).isNotNull()).select(*key, F.col(ts).alias("_t"), F.col(row_id).alias("_row"), F.lit(False).alias("_is"))
    times = asked.select(*key, "_t", F.lit(None).cast(df.schema[row_id].dataType).alias("_row"), F.lit(True).alias("_is"))
    # a time of rows and one of targets: whether it is asked for, and its first row
    both = time_blocks(rows.unionByName(times).groupBy(*key, "_t").agg(F.min("_row").alias("_row"), F.max("_is").alias("_is")), "_t", seconds, key, block)
    head = F.struct("_t", "_row")
    ahead = Window.partitionBy(*key, "_b").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_found", F.last(F.when(F.col("_row").isNotNull(), head), ignorenulls=True).over(ahead)).where("_is")
    # first row of every bucket, and of the next one that has rows: one row a bucket
    heads = both.groupBy(*key, "_b").agg(F.min(F.when(F.col("_row").isNotNull(), head)).alias("_head"))
    runs = Window.partitionBy(*(key or [F.lit(0)])).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = heads.withColumn("_next", F.last("_head", ignorenulls=True).over(runs)).select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_b").alias("_nb"), "_next")

    def within(on: Column) -> Column:
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return on

    told = inside.join(nexts, within(F.col("_b") == F.col("_nb")), "left").withColumn("_first", F.coalesce("_found", "_next"))
    told = told.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_t").alias("_at"), "_first")
    found = F.col("_first")
    return asked.join(told, within(F.col("_t") == F.col("_at"))).select("_ask.*", found["_t"].alias("found_ts"), found["_row"].alias("found_row"))


def _edges(df: DataFrame, row: str, flag: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block and flag; a row a block with its first and last flagged row and those of the blocks around it."""
    marked = df.withColumn("_b", F.floor(F.col(row) / rows)).withColumn("_f", F.coalesce(flag, F.lit(False)))
    blocks = marked.groupBy("_b").agg(F.min(F.when(F.col("_f"), F.col(row))).alias("_lo"), F.max(F.when(F.col("_f"), F.col(row))).alias("_hi"), F.count_if("_f").alias("_hits"))
    # one row a block
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    every = Window.partitionBy(F.lit(0))
    blocks = (
        blocks.withColumn("_after", F.last("_lo", ignorenulls=True).over(down))
        .withColumn("_before", F.last("_hi", ignorenulls=True).over(up))
        .withColumn("_done", F.coalesce(F.sum("_hits").over(up), F.lit(0)))
        .withColumn("_first", F.min("_lo").over(every))
        .withColumn("_last", F.max("_hi").over(every))
        .drop("_lo", "_hi", "_hits")
    )
    return marked, blocks


def next_marked(df: DataFrame, row: str, flag: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds next_marked and previous_marked: the nearest flagged rows after and before, going round at the ends. `row` numbers the
    rows in the order that counts."""
    marked, blocks = _edges(df, row, flag, rows)
    up, down = (Window.partitionBy("_b").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(row), F.desc(row)))
    own = F.when(F.col("_f"), F.col(row))
    marked = marked.withColumn("_n", F.last(own, ignorenulls=True).over(down)).withColumn("_p", F.last(own, ignorenulls=True).over(up))
    return marked.join(blocks, "_b").withColumn("next_marked", F.coalesce("_n", "_after", "_first")).withColumn("previous_marked", F.coalesce("_p", "_before", "_last")).drop("_b", "_f", "_n", "_p", "_after", "_before", "_done", "_first", "_last")


def hit_positions(df: DataFrame, row: str, hit: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows that hit, with hit_number (from 1) and next_hit (going round at the end)."""
    marked, blocks = _edges(df, row, hit, rows)
    hits = marked.where("_f").join(blocks, "_b")
    here = Window.partitionBy("_b").orderBy(row)
    return hits.withColumn("hit_number", (F.col("_done") + F.row_number().over(here)).cast("long")).withColumn("next_hit", F.coalesce(F.lead(row).over(here), "_after", "_first")).drop("_b", "_f", "_after", "_before", "_done", "_first", "_last")
