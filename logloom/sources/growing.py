"""Files that grow, as a stream: each batch reads the lines that were finished since the last one, through rotation.

The offset kept in the stream's checkpoint has a byte position for each file, known by its device and inode rather than by
its name, and checksums of its first bytes. So a restart neither loses nor repeats lines, and

- a file that was renamed is read on under its new name, whether the pattern matches it or not (over a restart: for as long as
  the new name begins with the old one), and the new file of the old name from its start;
- a file whose first bytes changed or that got shorter was cut: it is read from its start, and a copy that was made before
  (a file whose first bytes are those that the cut one had) is read on from where the cut one was.

What a cut or a deletion took away before a batch saw it is lost; so are cuts after which the first KNOWN bytes are the same. The
files must be under a path that the driver and all executors open alike (a local disk with Spark local, or a mounted share).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.scratch import exists

#: Bytes of a file that one task reads, about; bytes of a batch of rows; bytes by which a file is known.
SPLIT, ROWS_BYTES, KNOWN = 64 << 20, 4 << 20, 1024
SCHEMA = "source string, line_id bigint, raw string, file string, fresh boolean"


def _source() -> type:
    """The data source, made inside a function so that workers get it by value and need not import this package."""
    import glob
    import os
    import zlib

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    known, rows_bytes, schema_text = KNOWN, ROWS_BYTES, SCHEMA

    def line_end(f, at: int, least: int = 0) -> int:
        """End of the last finished line of the first `at` bytes, not below `least`."""
        while at > least:
            start = max(least, at - (1 << 16))
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return least

    def next_end(f, at: int) -> int | None:
        """End of the line that goes on at `at`; None if it has none yet."""
        f.seek(at)
        while chunk := f.read(1 << 16):
            found = chunk.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(chunk)
        return None

    def heads(f, upto: int) -> list[int]:
        """Checksums of the first 1, 2, 4 ... bytes, as far as `upto`."""
        f.seek(0)
        data, out, n = f.read(min(known, upto)), [], 1
        while n <= len(data):
            out.append(zlib.crc32(data[:n]))
            n *= 2
        return out

    def alike(a: list[int], b: list[int]) -> bool:
        return all(x == y for x, y in zip(a, b))

    def identity(stat) -> str:
        return f"{stat.st_dev}-{stat.st_ino}"

    class Part(InputPartition):
        def __init__(self, key: str, file: str, path: str, start: int, stop: int, fresh: bool):
            self.key, self.file, self.path, self.start, self.stop, self.fresh = key, file, path, start, stop, fresh

    def listing(pattern: str, limit: int = 0, before: dict | None = None) -> dict:
        """All files beside those that match: identity -> [path, end of finished lines, checksums, mark]. The mark is 2 for
        files that match or did, 1 for those whose names begin with one that matches, else 0.."""
        matched = {p for p in glob.glob(pattern) if os.path.isfile(p)}
        folders = {os.path.dirname(p) or "." for p in matched} | {os.path.dirname(pattern)} - {""}
        stems = tuple(os.path.basename(p) for p in {*matched, pattern})
        out = {}
        for folder in sorted(f for f in folders if os.path.isdir(f)):
            for name in sorted(os.listdir(folder)):
                path = os.path.join(folder, name)
                try:
                    with open(path, "rb") as f:
                        stat = os.fstat(f.fileno())
                        was = (before or {}).get(identity(stat))
                        at = was[1] if was else 0
                        end = line_end(f, stat.st_size)
                        if limit and end > at + limit:
                            end = line_end(f, at + limit, at)
                            end = end if end > at else next_end(f, at + limit) or at
                        now = [path, end, heads(f, end), 2 if path in matched or was and was[3] == 2 else int(name.startswith(stems))]
                        if was and (not alike(was[2], now[2]) or stat.st_size < was[1]) and limit:  # cut: its limit counts from its start
                            now[1] = line_end(f, min(stat.st_size, limit)) or next_end(f, limit) or 0
                            now[2] = heads(f, now[1])
                except OSError:  # a folder, or a file that has just gone
                    continue
                out[identity(stat)] = now
        return out

    def plan(start: dict, end: dict, split: int) -> list:
        """Parts of what `end` has and `start` has not; the same ones whenever it is asked."""
        cut = {k for k, (_, at, head, _) in start.items() if k in end and (end[k][1] < at or not alike(head, end[k][2]))}
        copies = {}
        for k in sorted(cut):
            _, at, head, followed = start[k]
            for other in sorted(end) if followed == 2 and at else ():
                # its bytes, under another identity
                if other not in start and end[other][1] >= at and len(head) <= len(end[other][2]) and alike(head, end[other][2]):
                    copies[other] = k
                    break
        out = []
        for key, (path, stop, _, follows) in sorted(end.items()):
            if key in copies:
                at, file, fresh = start[copies[key]][1], copies[key], False
            elif key in start and key not in cut:
                at, file, fresh = start[key][1], key, start[key][1] == 0
                follows = max(follows, start[key][3]) > 0
            else:
                at, file, fresh, follows = 0, key, True, follows == 2
            if follows or key in copies:
                out += [Part(key, file, path, a, min(a + split, stop), fresh) for a in range(at, stop, split)]
        return out

    def opened(part: Part):
        """The part's file, under whatever name it has by now; None if it is gone."""
        folder = os.path.dirname(part.path) or "."
        names = [part.path, *(os.path.join(folder, n) for n in (os.listdir(folder) if os.path.isdir(folder) else ()))]
        for path in names:
            try:
                f = open(path, "rb")
            except OSError:
                continue
            if identity(os.fstat(f.fileno())) == part.key:
                return f
            f.close()
        return None

    def read(part: Part):
        """Lines that start in a part, as Arrow batches; a line that starts there may end after it."""
        import pyarrow as pa

        f = opened(part)
        if f is None:
            return
        with f:
            at = part.start
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at = next_end(f, at)
            while at is not None and at < part.stop:
                f.seek(at)
                data = f.read(min(rows_bytes, part.stop - at))
                if not data:
                    return
                if not data.endswith(b"\n"):
                    whole = data.rfind(b"\n") + 1
                    if whole and len(data) == rows_bytes:
                        data = data[:whole]
                    else:
                        data += f.readline()
                lines = data.split(b"\n")
                if lines[-1] == b"":
                    lines.pop()
                ids, place = [], at
                for line in lines:
                    ids.append(place)
                    place += len(line) + 1
                keep = [k for k, i in enumerate(ids) if i < part.stop]
                raws = [lines[k].removesuffix(b"\r").decode("utf-8", "replace") for k in keep]
                if raws and at == 0:
                    raws[0] = raws[0].removeprefix("\ufeff")
                n = len(raws)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * n, pa.string()), pa.array([ids[k] for k in keep], pa.int64()), pa.array(raws, pa.string()), pa.array([part.file] * n, pa.string()), pa.array([part.fresh] * n, pa.bool_())],
                    ["source", "line_id", "raw", "file", "fresh"],
                )
                at += len(data)

    class Reader(DataSourceStreamReader):
        def __init__(self, path: str, split: int, limit: int, start: str):
            self.path, self.split, self.limit, self.first = path, split, limit, json.loads(start) if start else {}
            self.seen: dict | None = None

        def initialOffset(self) -> dict:
            return {"files": self.first}

        def latestOffset(self) -> dict:
            # at a start or restart the last offset is not known here: the first batch has no limit
            self.seen = listing(self.path, self.limit if self.seen is not None else 0, self.seen)
            return {"files": self.seen}

        def partitions(self, start: dict, end: dict) -> list:
            for key, was in start["files"].items():  # what was followed is followed under any name
                if was[3] == 2 and self.seen and key in self.seen:
                    self.seen[key][3] = 2
            return plan(start["files"], end["files"], self.split)

        def read(self, partition: Part):
            return read(partition)

        def commit(self, end: dict) -> None:
            pass

    class Until(DataSourceReader):
        def __init__(self, stop: str, split: int):
            self.stop, self.split = json.loads(stop), split

        def partitions(self) -> list:
            return plan({}, self.stop, self.split)

        def read(self, partition: Part):
            return read(partition)

    class GrowingLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "growing_lines"

        def schema(self) -> str:
            return schema_text

        def reader(self, schema: object) -> Until:
            return Until(self.options["until"], int(self.options["split"]))

        def streamReader(self, schema: object) -> Reader:
            return Reader(self.options["path"], int(self.options["split"]), int(self.options["limit"]), self.options.get("start", ""))

    GrowingLines.listing = staticmethod(listing)
    return GrowingLines


def follow(spark: SparkSession, path: str, split: int = SPLIT, limit: int = 0, start: str = "") -> DataFrame:
    """source, line_id (the line's first byte in its file), raw, file (stays the same over renames), fresh (whether the batch reads the
    file from its start) of the files that match a glob, as they grow. A last line without its line end waits for it. limit:
    bytes of a file that a batch takes, about (0: all); the first batch after a start takes all there is (use history() before that). start: offsets() to go on
    from."""
    spark.dataSource.register(_source())
    return spark.readStream.format("growing_lines").option("path", path).option("split", str(split)).option("limit", str(limit)).option("start", start).load()


def offsets(path: str) -> str:
    """Where the files that match a glob end now: what history() reads up to and follow() starts from. One entry a file."""
    return json.dumps(_source().listing(path))


def history(spark: SparkSession, until: str, split: int = SPLIT) -> DataFrame:
    """The lines before offsets(), in one batch; columns as those of follow()."""
    spark.dataSource.register(_source())
    return spark.read.format("growing_lines").option("until", until).option("split", str(split)).load()


class Numbered:
    """A sink that gives the lines of follow() their numbers, from 0 in each file and over all batches, as line_id, and hands them on.

    Lines are counted in blocks of bytes: a block's number is what the blocks before it in its file hold, so no window spans a
    file. Lines a file has had are kept in a table beside the stream's, a version a batch: a batch that runs again counts once."""

    def __init__(self, path: str, sink, block: int = SPLIT):
        self.path, self.sink, self.block = path, sink, block

    def __call__(self, batch: DataFrame, number: int) -> None:
        from logloom.streaming.stream import Merged

        spark = batch.sparkSession
        counts = Merged(spark, self.path, lambda now, new: new)
        had = [v for v in counts.versions() if v < number]
        rows = batch.withColumn("_b", F.floor(F.col("line_id") / self.block))
        own = rows.groupBy("file", "fresh", "_b").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("file", "fresh").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        old = spark.read.parquet(f"{self.path}/v{had[-1]}") if had and exists(spark, f"{self.path}/v{had[-1]}") else spark.createDataFrame([], "file string, lines bigint")
        base = F.when(F.col("fresh"), 0).otherwise(F.coalesce("lines", F.lit(0)))
        blocks = own.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(old, "file", "left").select("file", "fresh", "_b", (F.col("_before") + base).alias("_first"), "_n")
        place = F.row_number().over(Window.partitionBy("file", "fresh", "_b").orderBy("line_id")) - 1
        named = rows.join(blocks.drop("_n"), ["file", "fresh", "_b"]).withColumn("line_id", (F.col("_first") + place).cast("long"))
        # a file that was cut goes on from its new lines
        ends = blocks.groupBy("file").agg(F.max(F.struct("fresh", (F.col("_first") + F.col("_n")).alias("lines")))["lines"].alias("new"))
        counts(old.join(ends, "file", "full").select("file", F.coalesce("new", "lines").alias("lines")), number)
        self.sink(named.drop("_b", "_first", "fresh"), number)
