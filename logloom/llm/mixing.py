"""Mixing sources to target weights, native.

Every document gets a hash-random key. Each source's documents are ordered by that key, range-split into bins by it,
and prefix sums of their sizes run over bins and then inside each bin, so that no source, however large, is summed in
one task. A source's budget is cut at its exact size; a budget beyond the source's size repeats it whole first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows of one bin, about.
BIN_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source_key, source_size -> with target. One row a source.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; a target stops at
    `epochs` times its source's size and the excess is shared again by weight until none is above. In closed form:
    in the order of size / weight the sources fill up first that reach their stop below the common level.
    Sources without words get 0. The windows run over one row a source.
    """
    all_rows = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("stop", F.col("source_size") * float(epochs))
    order = all_rows.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("left", F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("stop"))
    )
    # all before the first source that is not full are full; the level of that source holds for it and all after it
    level = F.min(F.when(~F.col("full"), F.struct((F.col("stop") / F.col("weight")).alias("o"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("level")))).over(all_rows)["level"]
    return s.withColumn("common", level).select(
        "source", "source_size", F.when(F.col("full") | F.col("common").isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("common") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, cut: str = "exact", keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "", bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the document, repeats counted), and
    the columns in `keep`.

    cut "exact" ends a source's last epoch at its target, rounded to words, inside a document if need be; "nearest"
    keeps documents whole and takes the one at the cut if that comes nearer. Empty and null texts have size 0 and
    are taken 0 words. Rows of equal id are ordered by size; which of two fully equal rows is cut makes no
    difference to the rows returned. The key is md5(seed, id), so reruns agree. An empty table gives an empty one.
    Columns in `keep` may have any name but those of the result's other columns, else ValueError. Without such columns the
    texts are read once and only ids, sources and sizes are written and read again.
    """
    source = F.col(source_col)
    into, back = common.kept(keep, ("doc_id", "source", "size", "source_size", "target", "taken"))
    base = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), common.words_count(F.col(text_col)).alias("size"), *into)
    if not keep:
        base = common.materialise(base, "mix-sizes")
    base = base.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goal = targets(per.select("source", "source_size"), weights, share, epochs)
    # one row a source: sources are names; a table of them is broadcast only if it is small
    goal = goal.join(per.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = common.materialise(goal, "mix-goals")
    n_sources = goal.count()
    goal = (F.broadcast(goal) if n_sources <= 100_000 else goal).withColumnRenamed("source", "g")
    fraction = F.conv(F.substring("key", 1, 13), 16, 10).cast("long")
    binned = (
        base.join(goal, F.col("source").eqNullSafe(F.col("g")), "left").drop("g")
        .withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bin_rows)).cast("long"))
        .withColumn("bin", F.floor(fraction / F.lit(2.0**52) * F.col("bins")).cast("long"))
    )
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    offsets = _offsets(totals)
    out = binned.withColumn("upto", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))
    )
    before = F.col("offset") + F.col("upto") - F.col("size")
    budget = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    return out.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + _last(rest, before, F.col("size"), cut)).cast("long").alias("taken"), *back)


def _last(rest: Column, before: Column, size: Column, cut: str) -> Column:
    """Words of a document in its source's last, partial epoch."""
    inside = F.greatest(F.lit(0), F.least(size, rest - before))
    if cut == "exact":
        return inside
    return F.when(2 * inside >= size, size).otherwise(0)


def _offsets(totals: DataFrame) -> DataFrame:
    """s, b, offset: sizes in all earlier bins of the source. In two levels, as a source may have many bins: runs of
    1024 bins, then the bins of each run."""
    t = totals.withColumn("run", F.floor(F.col("bin") / 1024))
    over_runs = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy("source", "run").agg(F.sum("bin_size").alias("run_size")).select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("run_size").over(over_runs), F.lit(0)).alias("run_offset"))
    over_bins = Window.partitionBy("source", "run").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return (
        t.withColumn("inner", F.coalesce(F.sum("bin_size").over(over_bins), F.lit(0)))
        .join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
        .select("s", F.col("bin").alias("b"), (F.col("run_offset") + F.col("inner")).alias("offset"))
    )


def op5_mix_sources(spark, sf_dir):
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS stop FROM per),
o AS (SELECT *,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(stop) OVER b, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights_left FROM w
  WINDOW b AS (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, remaining / weights_left AS level, remaining / weights_left * weight >= stop AS is_full FROM o),
c AS (SELECT (SELECT level FROM l WHERE NOT is_full ORDER BY stop / weight, source ASC NULLS LAST LIMIT 1) AS common),
goals AS (SELECT source, source_size, CASE WHEN is_full OR common IS NULL THEN stop ELSE least(stop, common * weight) END AS target FROM l, c),
sums AS (SELECT base.*, goals.source_size, goals.target, round(goals.target)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM base JOIN goals ON base.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM sums
"""
