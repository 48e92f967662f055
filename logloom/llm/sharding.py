"""Sharding by sampled splitters, native.

Records lie on a line: by the CRC-32 of their text, then, where one value is overfull, by a hash of their id. A
sample of keys, drawn with a chance that follows size, gives quantile boundaries for many narrow ranges of about
equal bytes. The ranges' exact bytes are counted, overfull ones are subdivided, and whole ranges are dealt to the
shards, largest first, each to the shard with the fewest bytes. Equal texts share a range, and so a shard, unless
they alone hold a notable part of a shard (1/32).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

SHARDS = 8
#: Ranges a shard has at least; sampled keys a range.
RANGES, SAMPLES = 128, 32


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law 'bytes', shard, slot (gapless from 0 in each
    shard), grown_shard (null under this law), and the columns in `keep`.

    Null texts count as empty ones. Rows that are equal in id and text get slots in arbitrary order among
    themselves. An empty table gives an empty one. Columns in `keep` may have any name but those of the result's other
    columns, else ValueError. A part of many rows is numbered in bins by the id's hash, each after the bins before it.
    """
    spark = docs.sparkSession
    into, back = common.kept(keep, ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    ranges = ranges or max(shards * RANGES, 16 * common.partitions(spark))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), *into)
    thin = base.select("doc_id", "size", "text_crc32")
    base_salt = F.xxhash64("doc_id", F.lit(17))
    whole = thin.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, crowd = whole["bytes"] or 0, max(1, 2 * whole["rows"] // ranges)
    # 1. size-weighted sample of keys: a record is drawn with chance size / step, at most 1; heavier ones weigh the more
    step = max(1.0, total / (ranges * SAMPLES))
    draw = F.pmod(base_salt, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = thin.where(draw < F.col("size") / F.lit(step)).groupBy("text_crc32").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") / step)).alias("weight"))
    drawn = sorted((r["text_crc32"], r["weight"]) for r in sample.collect())  # about ranges * SAMPLES keys, whatever the input
    splitters = _quantiles(drawn, ranges)
    ranged = thin.withColumn("range", common.range_bin(F.col("text_crc32"), splitters))
    # 2. exact bytes, and overfull ranges subdivided: by key where that helps, else by a hash of the id
    limit = max(1.0, 2.0 * total / ranges)
    counted = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("text_crc32").alias("low"), F.max("text_crc32").alias("high")).collect()}
    overfull = {k: r for k, r in counted.items() if r["bytes"] > limit}
    parts = {k: int(r["bytes"] / (limit / 2)) + 1 for k, r in overfull.items()}
    by_range = {k: parts.get(k, 1) for k in counted}
    lookup = F.expr("array(" + ",".join(str(by_range.get(k, 1)) for k in range(max(counted, default=0) + 1)) + ")")
    n_parts = F.element_at(lookup, F.col("range") + 1)
    n_bins = F.element_at(F.expr("array(" + ",".join(str(-(-counted[k]["rows"] // crowd) if k in counted else 1) for k in range(max(counted, default=0) + 1)) + ")"), F.col("range") + 1)
    group_limit = max(limit, total / (32 * shards))
    # a range of several texts is subdivided by text first, and the part of a text that alone overfills it by id
    texts = {k: r["high"] > r["low"] for k, r in overfull.items()}
    heavy = []
    if any(texts.values()):
        wide = ranged.where(F.col("range").isin([k for k, v in texts.items() if v])).groupBy("text_crc32").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > group_limit)
        heavy = [r["text_crc32"] for r in wide.collect()]  # each has over 1 / (32 * shards) of all bytes: fewer than that
    heavy += [r["low"] for k, r in overfull.items() if not texts[k] and r["bytes"] > group_limit]
    by_id = F.col("text_crc32").isin(heavy) if heavy else F.lit(False)
    part = F.pmod(F.when(by_id, base_salt).otherwise(F.xxhash64("text_crc32")), n_parts).cast("int")
    part = part + F.when(by_id, n_parts).otherwise(0)
    placed = lambda df: df.withColumn("range", common.range_bin(F.col("text_crc32"), splitters)).withColumn("part", part).withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(23)), n_bins).cast("int"))
    # 3. whole parts to shards, largest first
    bins = placed(thin).groupBy("range", "part", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    sizes: dict[tuple[int, int], list] = {}
    for r in bins:
        sizes.setdefault((r["range"], r["part"]), []).append(r)
    load = [(0, s) for s in range(shards)]
    filled = [0] * shards
    rows = []
    for size, key in sorted((-sum(r["bytes"] for r in own), key) for key, own in sizes.items()):
        held, s = heapq.heappop(load)
        for r in sorted(sizes[key], key=lambda r: r["bin"]):
            rows.append((*key, r["bin"], s, filled[s]))
            filled[s] += r["rows"]
        heapq.heappush(load, (held - size, s))
    table = spark.createDataFrame(rows, "range int, part int, bin int, shard int, first_slot bigint")  # at most about 4 * ranges rows
    inside = Window.partitionBy("range", "part", "bin").orderBy("text_crc32", "doc_id", "size")
    return (
        placed(base)
        .withColumn("inner", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), ["range", "part", "bin"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *back)
    )


def _quantiles(drawn: list[tuple[int, float]], ranges: int) -> list[int]:
    """Keys that cut the drawn weight into equal shares."""
    total, run, out = sum(w for _, w in drawn), 0.0, []
    for key, weight in drawn:
        if run >= total / ranges * (len(out) + 1):
            out.append(key)
        run += weight
    return sorted(set(out))


def op1_shards(spark, sf_dir):
    return shard(common.table(spark, sf_dir, "documents"))
