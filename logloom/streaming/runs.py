"""A sorted view of a stream, and the newest rows with their histogram, without sorting or reading again what was there.

Each batch is written as a sorted run: files of at most BLOCK rows, in order. A small table of fences (first and last key and number
of rows of each file) tells which files can hold the rows at given places of the sorted view; only these are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.scratch import folders, remove
from logloom.operators import histogram, sorting
from logloom.streaming.stream import RETAIN, RETAIN_RANGE, Merged

BLOCK, RUNS = 65_536, 16
#: Ranges of row ids whose rows are counted at once.
RANGES = 65_536


class SortedRuns(Merged):
    """A sink that inserts each batch into a sorted view: column, descending, row_id, kind and mapping as operators.sorting has them.

    Runs are merged when there are more than `runs` of them: the small ones, as long as the next larger is no larger than they are
    together, so a row is rewritten about as often as the table doubles. A batch that runs again replaces its run. Files that neither
    the last version nor the one before names are deleted. Row ids tell rows apart; rows of equal ids come in any order."""

    def __init__(self, spark: SparkSession, path: str, column: str, descending: bool = False, row_id: str = "row_id", kind: str | None = None, mapping: dict[str, str] | None = None, block: int = BLOCK, runs: int = RUNS):
        super().__init__(spark, path, lambda now, batch: now)
        self.column, self.descending, self.row_id, self.kind, self.mapping, self.block, self.runs = column, descending, row_id, kind, mapping, block, runs
        self.columns = T.StructType()  # of the last batch: those of a view without rows

    def _order(self) -> list[Column]:
        return [F.col("_key").desc_nulls_first() if self.descending else F.col("_key").asc_nulls_last(), F.col("_row").asc()]

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """Write rows that have _key and _row in order; the fences of the files."""
        where = f"{self.path}/run-{name}"
        rows.orderBy(*self._order()).write.mode("overwrite").option("maxRecordsPerFile", self.block).parquet(where)
        keys = F.struct("_key", "_row")
        at = F.col("_metadata.row_index")
        found = self.spark.read.schema(rows.schema).parquet(where).select(keys.alias("k"), at.alias("i"), F.col("_metadata.file_path").alias("file"))
        return found.groupBy("file").agg(F.min_by("k", "i").alias("low"), F.max_by("k", "i").alias("high"), F.count(F.lit(1)).alias("rows")).withColumn("run", F.lit(f"run-{name}"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        fences = self.insert(self.before(number), batch, number)
        self.keep_runs(fences, number)
        fences.unpersist()

    def insert(self, now: DataFrame | None, batch: DataFrame, number: int) -> DataFrame:
        rows = batch.withColumn("_key", sorting.sort_key(batch, self.column, self.kind, self.mapping)).withColumn("_row", F.col(self.row_id))
        self.columns = rows.schema
        fences = self._write(rows, str(number))
        both = (fences if now is None else now.select(*fences.columns).unionByName(fences)).persist()
        sizes = sorted((r["n"], r["run"]) for r in both.groupBy("run").agg(F.sum("rows").alias("n")).collect())  # one row a run
        if len(sizes) <= self.runs:
            return both
        few, total = [], 0
        for n, run in sizes:
            if len(few) > 1 and n > total:
                break
            few.append(run)
            total += n
        small = F.col("run").isin(few)
        merged = self._write(self._read(self._files(both.where(small))), f"{number}-merged")
        return both.where(~small).unionByName(merged).persist()

    def keep_runs(self, fences: DataFrame, number: int) -> None:
        self.keep(fences, number)
        named = {r["run"] for v in self.versions() for r in self.spark.read.parquet(f"{self.path}/v{v}").select("run").distinct().collect()}  # one row a run
        for name in folders(self.spark, self.path):
            if name.startswith("run-") and name not in named:
                remove(self.spark, f"{self.path}/{name}")

    def _files(self, fences: DataFrame) -> list[str]:
        return [r["file"] for r in fences.select("file").collect()]  # one row a file of BLOCK rows

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*files) if files else self.spark.createDataFrame([], self.columns)

    def overlapping(self, fences: DataFrame, first: int, last: int) -> tuple[list[str], int]:
        """The files that can hold a place from first up to last (not included), and how many rows lie in files before them.

        A file's rows stand behind all files that end before it begins, and before none that begins after its end."""
        ends = fences.select(F.col("low.*"), "file", F.lit(0).alias("_end"), F.col("rows").alias("_n")).unionByName(fences.select(F.col("high.*"), "file", F.lit(1).alias("_end"), F.col("rows").alias("_n")))
        upto = Window.orderBy(*self._order(), "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows a file
        sums = ends.withColumn("_ended", F.sum(F.col("_n") * F.col("_end")).over(upto)).withColumn("_begun", F.sum(F.col("_n") * (1 - F.col("_end"))).over(upto))
        places = sums.groupBy("file").agg(F.min(F.when(F.col("_end") == 0, F.col("_ended"))).alias("least"), F.max(F.when(F.col("_end") == 1, F.col("_begun"))).alias("most"), F.min("_n").alias("rows"))
        told = places.where(F.col("least") < last).collect()  # one row a file
        return [r["file"] for r in told if r["most"] > first], sum(r["rows"] for r in told if r["most"] <= first)

    def page(self, first: int, last: int, fences: DataFrame | None = None) -> DataFrame:
        """The rows at the places from first up to last (not included) of the sorted view, in order. A view without rows has the columns of
        the last batch."""
        files, before = self.overlapping(self.table() if fences is None else fences, first, last)
        return self._read(files).orderBy(*self._order()).offset(first - before if files else 0).limit(max(last - first, 0)).drop("_key", "_row")


class RetainedHistogram(SortedRuns):
    """The newest n rows by row_id, and the histogram of just these. A batch adds its counts to the buckets, and the rows that it pushes out
    come as negative counts; buckets without rows go. Of the kept rows only those are read that go, and the rest of their files. Rows that
    n others of their own batch push out are neither written nor counted.

    Rows below all that was pushed out before are late: they are pushed out at once. Row ids are whole numbers and differ."""

    def __init__(self, spark: SparkSession, path: str, ts: str, level: str, seconds: int, n: int = RETAIN, row_id: str = "row_id", mapping: dict[str, str] | None = None, block: int = BLOCK, runs: int = RUNS):
        super().__init__(spark, f"{path}/rows", row_id, row_id=row_id, block=block, runs=runs)
        self.n = max(RETAIN_RANGE[0], min(RETAIN_RANGE[1], n))
        self.ts, self.level, self.seconds, self.levels = ts, level, seconds, mapping
        self.buckets = Merged(spark, f"{path}/buckets", lambda now, batch: now)

    def _counts(self, rows: DataFrame, sign: int) -> DataFrame:
        out = histogram.histogram(rows, self.ts, self.level, self.seconds, self.levels)
        return out.select("bucket_start", *((F.col(c) * sign).alias(c) for c in (*histogram.SLOTS, "total")))

    def _least(self, rows: DataFrame) -> int | None:
        """A row id that n rows reach, and few more; None if there are no more than n rows. Rows are counted by ranges of ids, then by
        ranges of the range that holds the n-th, until few are left in it; only that range reaches the driver."""
        of = F.col(self.row_id).cast("long")
        low, high, count = rows.agg(F.min(of), F.max(of), F.count(of)).first()
        wanted = self.n
        if count <= wanted:
            return None
        while True:
            width = (high - low) // RANGES + 1
            counts = rows.where(of.between(low, high)).select(of.alias("_id")).groupBy(F.expr(f"({high} - _id) DIV {width}").alias("_range")).count()
            upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most RANGES rows
            at = counts.withColumn("_upto", F.sum("count").over(upto)).where(F.col("_upto") >= wanted).orderBy("_range").first()
            high -= at["_range"] * width
            low = max(high - width + 1, low)
            wanted -= at["_upto"] - at["count"]
            if width == 1 or at["count"] - wanted <= self.n:
                return low

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.before(number)
        old, dead = now.agg(F.max("floor"), F.coalesce(F.max("dead"), F.lit(0))).first() if now is not None else (None, 0)
        new = batch if old is None else batch.where(F.col(self.row_id) > old)
        least = self._least(new)
        if least is not None:
            new = new.where(F.col(self.row_id) >= least)
        fences = self.insert(now, new, number)
        rows = fences.agg(F.sum("rows")).first()[0] or 0
        parts = [self._counts(new, 1)]
        floor, gone, left = old, max(rows - dead - self.n, 0), fences
        if gone:
            floor = self.page(dead + gone - 1, dead + gone, fences).first()[self.row_id]  # the last row that goes
            evicted = self._read(self.overlapping(fences, dead, dead + gone)[0]).where(F.col(self.row_id) <= floor)
            parts.append(self._counts(evicted if old is None else evicted.where(F.col(self.row_id) > old), -1))
            whole = fences.where(F.col("high._row") <= floor).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            left, dead = fences.where(F.col("high._row") > floor), dead + gone - whole
        if least is not None:  # what is below was pushed out, too
            floor = least - 1 if floor is None else max(floor, least - 1)
        buckets = self.buckets.before(number)
        total = parts[0] if buckets is None else buckets.unionByName(parts[0])
        for p in parts[1:]:
            total = total.unionByName(p)
        merged = total.groupBy("bucket_start").agg(*(F.sum(c).alias(c) for c in (*histogram.SLOTS, "total"))).where("total > 0")
        self.buckets.keep(merged, number)
        self.keep_runs(left.withColumn("floor", F.lit(floor).cast("long")).withColumn("dead", F.lit(dead).cast("long")), number)
        fences.unpersist()

    def histogram(self) -> DataFrame:
        return self.buckets.table()

    def kept(self) -> DataFrame:
        fences = self.table()
        floor = fences.agg(F.max("floor")).first()[0]
        rows = self._read(self._files(fences)).drop("_key", "_row")
        return rows if floor is None else rows.where(F.col(self.row_id) > floor)
