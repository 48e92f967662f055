"""Files of any codec in pieces, each read as a stream by its own task, and their first lines alone.

A piece is a range of compressed bytes: any range of a plain file, bzip2 streams, xz blocks by the index at the file's end, zstd frames by
their block headers, gzip members where they state their length (as bgzip writes them). A gzip file of other members is one piece, and so
is one bzip2 stream, one xz block or one zstd frame, however long: it is decompressed a CHUNK at a time.

A line belongs to the piece that holds the line end before it, and a file's first line to its first piece; the reader goes on into the next
pieces for the rest of its last line. Files are opened in the tasks by pyarrow; the driver sees neither bytes nor pieces."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
ROWS = 10_000
PIECE_SCHEMA = "source string, codec string, size bigint, start bigint, stop bigint, last boolean"

# Fixed values of the formats.
GZIP, BZIP2, XZ, ZSTD = b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"
BZIP2_BLOCK = b"1AY&SY"
XZ_HEAD = XZ_FOOT = 12
ZSTD_SKIPPED = range(0x184D2A50, 0x184D2A60)


def local(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name as Spark writes it."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}:/{quote(rest, safe='/:@')}")


def opened(path: str) -> io.IOBase:
    system, name = local(path)
    return system.open_input_file(name)


def reachable(path: str) -> bool:
    """Whether tasks can open the path themselves; pyarrow does not know every file system that Spark does."""
    try:
        system, name = local(path)
        return system.get_file_info(name).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def codec(head: bytes) -> str:
    """Codec by the first bytes, whatever the name: gzip, bzip2, xz, zstd or none."""
    for mark, name in ((GZIP, "gzip"), (XZ, "xz"), (ZSTD, "zstd")):
        if head.startswith(mark):
            return name
    if len(head) >= 4 and int.from_bytes(head[:4], "little") in ZSTD_SKIPPED:
        return "zstd"
    # an empty stream has its end where a block would begin
    return "bzip2" if head[:3] == BZIP2 and head[3:4].isdigit() and head[4:10] in (BZIP2_BLOCK, b"\x17\x72\x45\x38\x50\x90") else "none"


class _Range(io.RawIOBase):
    """The bytes of a file from start to stop."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.at, self.stop = file, start, stop

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def readinto(self, into) -> int:
        self.file.seek(self.at)
        got = self.file.read(min(len(into), self.stop - self.at))
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


def _drained(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def _bzip2_start(file, start: int, stop: int) -> int | None:
    """Place of the first bzip2 stream that begins in [start, stop)."""
    at, held = start, b""
    while at - len(held) < stop:
        file.seek(at)
        new = file.read(CHUNK)
        if not new:
            return None
        held, at = held + new, at + len(new)
        found = held.find(BZIP2)
        while found >= 0 and found + 10 <= len(held):
            if held[found + 4 : found + 10] == BZIP2_BLOCK and held[found + 3 : found + 4].isdigit():
                return at - len(held) + found if at - len(held) + found < stop else None
            found = held.find(BZIP2, found + 1)
        held = held[-9:] if found < 0 else held[found:]
    return None


def _bzip2(file, start: int, stop: int) -> Iterator[bytes]:
    at = _bzip2_start(file, start, stop)
    while at is not None:
        unpack = bz2.BZ2Decompressor()
        file.seek(at)
        while not unpack.eof:
            new = file.read(CHUNK) if unpack.needs_input else b""
            if unpack.needs_input and not new:
                raise EOFError("a bzip2 stream has no end")
            at += len(new)
            if out := unpack.decompress(new, CHUNK):
                yield out
            if not unpack.eof:
                file.seek(at)  # the consumer may have read elsewhere
        at = _bzip2_start(file, at - len(unpack.unused_data), stop)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A whole number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def xz_blocks(file, size: int) -> list[tuple[int, int, int]]:
    """Blocks of an xz file by the indexes of its streams, read from the end: place of the stream's head, first byte, byte behind."""
    out, end = [], size
    while end > 0:
        file.seek(end - 4)
        tail = file.read(4)
        if tail == bytes(4):  # padding
            end -= 4
            continue
        file.seek(end - XZ_FOOT)
        foot = file.read(XZ_FOOT)
        if foot[10:] != b"YZ":
            raise EOFError("an xz stream has no end")
        length = (int.from_bytes(foot[4:8], "little") + 1) * 4
        file.seek(end - XZ_FOOT - length)
        index = file.read(length)
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            packed, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append((packed + 3) // 4 * 4)
        head = end - XZ_FOOT - length - sum(sizes) - XZ_HEAD
        if head < 0:
            raise EOFError("an xz index does not fit its file")
        place, blocks = head + XZ_HEAD, []
        for s in sizes:
            blocks.append((head, place, place + s))
            place += s
        out += reversed(blocks)
        end = head
    return out[::-1]


def _xz(file, start: int, stop: int, size: int) -> Iterator[bytes]:
    for head, first, behind in xz_blocks(file, size):
        if not start <= first < stop:
            continue
        unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        file.seek(head)
        unpack.decompress(file.read(XZ_HEAD))
        at = first
        while True:
            file.seek(at)
            new = file.read(min(CHUNK, behind - at)) if unpack.needs_input else b""
            if unpack.needs_input and not new:
                break
            at += len(new)
            if out := unpack.decompress(new, CHUNK):
                yield out


def zstd_frames(file, size: int) -> Iterator[int]:
    """Places of the frames of a zstd file; only headers of frames and blocks are read."""
    at = 0
    while at < size:
        yield at
        file.seek(at)
        head = file.read(18)
        if int.from_bytes(head[:4], "little") in ZSTD_SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if head[:4] != ZSTD:
            raise EOFError("a zstd frame has no end, or bytes follow it")
        checked = zstandard.get_frame_parameters(head).has_checksum
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            file.seek(at)
            block = int.from_bytes(file.read(3), "little")
            last, kind, length = block & 1, block >> 1 & 3, block >> 3
            if at >= size:
                raise EOFError("a zstd frame has no end")
            at += 3 + (1 if kind == 1 else length)
        at += 4 if checked else 0


def gzip_members(file, size: int) -> Iterator[int]:
    """Places of gzip members as far as they state their length; the last of these may hold the rest of the file."""
    at = 0
    while at < size:
        yield at
        file.seek(at)
        head = file.read(12)
        if len(head) < 12 or head[:2] != GZIP or not head[3] & 4:
            return
        extra = file.read(int.from_bytes(head[10:12], "little"))
        length = None
        while len(extra) >= 4:
            field = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"BC" and field == 2:
                length = int.from_bytes(extra[4:6], "little") + 1
            extra = extra[4 + field :]
        if length is None:
            return
        at += length


def chunks(file, kind: str, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Decompressed bytes of what begins in [start, stop), which are bounds that `bounds` gives, or 0 and size."""
    if start >= stop:
        return iter(())
    if kind == "bzip2":
        return _bzip2(file, start, stop)
    if kind == "xz":
        return _xz(file, start, stop, size)
    inside = io.BufferedReader(_Range(file, start, stop), CHUNK)
    if kind == "zstd":
        return _drained(zstandard.ZstdDecompressor().stream_reader(inside, read_across_frames=True))
    return _drained(gzip.GzipFile(fileobj=inside) if kind == "gzip" else inside)


def bounds(file, kind: str, size: int, piece: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `piece` bytes that cover a file and begin where it can be read from."""
    if size <= piece:
        places = iter([0])
    elif kind == "xz":
        places = (first for _, first, _ in xz_blocks(file, size))
    elif kind == "zstd":
        places = zstd_frames(file, size)
    elif kind == "gzip":
        places = gzip_members(file, size)
    else:
        places = iter(range(0, size, piece))
    start = 0
    for at in places:
        if at - start >= piece:
            yield start, at
            start = at
    yield start, size


def numbered(read: Iterator[bytes], rest: Callable[[], Iterator[bytes]], first: bool) -> Iterator[list[bytes]]:
    """The lines of a piece in lists. Of a piece that is not the first, what comes before its first line end is the line of a piece
    before; the last line goes on with rest(). A file that ends with a line end has no line behind it."""
    held, part, owned = [], [], first
    for chunk in read:
        head, *more = chunk.split(b"\n")
        if owned:
            part.append(head)
        if more:
            if owned:
                held.append(b"".join(part))
            owned = True
            *whole, tail = more
            held += whole
            part = [tail]
        if len(held) >= ROWS:
            yield held
            held = []
    if owned:
        ended = False
        for chunk in rest():
            head, end, _ = chunk.partition(b"\n")
            part.append(head)
            if end:
                ended = True
                break
        last = b"".join(part)
        if ended or last:
            held.append(last)
    if held:
        yield held


def _limited(read: Iterator[bytes], source: str, most: int) -> Iterator[bytes]:
    seen = 0
    for chunk in read:
        seen += len(chunk)
        if seen > most:
            raise ValueError(f"a piece of {source} is larger than {most} bytes once decompressed")
        yield chunk


def batch(source: str, first: int, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array(range(first, first + n), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines])], ["source", "line_id", "raw"])


def _plan(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(source) as file:
                    kind = codec(file.read(10))
                    out = []
                    for start, stop in bounds(file, kind, size, piece):
                        out.append({"source": source, "codec": kind, "size": size, "start": start, "stop": stop, "last": stop == size})
                        if len(out) >= ROWS:
                            yield _pieces(out)
                            out = []
                    yield _pieces(out)

    return run


def _pieces(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("source", pa.string()), ("codec", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("last", pa.bool_())])
    return pa.RecordBatch.from_pylist(rows, kinds)


def _ends(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                with opened(p["source"]) as file:
                    n = sum(c.count(b"\n") for c in _limited(chunks(file, p["codec"], p["size"], p["start"], p["stop"]), p["source"], most))
                yield pa.RecordBatch.from_pydict({"source": [p["source"]], "start": [p["start"]], "ends": [n]})

    return run


def _lines(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                with opened(p["source"]) as file:
                    own = _limited(chunks(file, p["codec"], p["size"], p["start"], p["stop"]), p["source"], most)
                    number = p["number"]
                    for lines in numbered(own, lambda p=p, file=file: chunks(file, p["codec"], p["size"], p["stop"], p["size"]), p["start"] == 0):
                        yield batch(p["source"], number, lines)
                        number += len(lines)

    return run


def pieces(files: DataFrame, piece: int) -> DataFrame:
    """Pieces of files (columns source and size), planned by tasks."""
    return files.select("source", "size").where("size > 0").mapInArrow(_plan(piece), PIECE_SCHEMA)


def read(files: DataFrame, piece: int, most: int, tasks: int) -> DataFrame:
    """source, line_id, raw of files (columns source and size). Files of several pieces are read twice, as `line_id` needs the counts
    of the pieces before; lines are not shuffled. A stated number of tasks, as pieces are few bytes to the optimizer, which would join them."""
    found = pieces(files, piece)
    spread = found.repartition(tasks, "source", "start")
    ends = spread.where("NOT last").mapInArrow(_ends(most), "source string, start bigint, ends bigint")
    before = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one row a piece
    counts = found.join(ends, ["source", "start"], "left").withColumn("number", F.when(F.col("start") == 0, 0).otherwise(F.sum("ends").over(before) + 1).cast("long"))
    return counts.repartition(tasks, "source", "start").mapInArrow(_lines(most), "source string, line_id bigint, raw string")


def heads(files: DataFrame, wanted: int) -> DataFrame:
    """source, line_id, raw of the first lines of files (column source), until `wanted` of them are not blank; no file is read further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                with opened(source) as file:
                    yield batch(source, 0, head(file, file.size(), wanted))

    return files.select("source").mapInArrow(run, "source string, line_id bigint, raw string")


def head(file, size: int, wanted: int) -> list[bytes]:
    """The first lines of a file, the blank ones among them, until `wanted` are not blank."""
    file.seek(0)
    kind, out, full, part = codec(file.read(10)), [], 0, []
    try:
        for chunk in _front(file, kind, size):
            first, *more = chunk.split(b"\n")
            part.append(first)
            for following in more:
                out.append(b"".join(part))
                full += bool(out[-1].strip(b" \t\r\n"))
                if full == wanted:
                    return out
                part = [following]
    except (EOFError, OSError, lzma.LZMAError, zlib.error, zstandard.ZstdError):
        if not out:
            raise  # a file that breaks off further on still has a head
    if last := b"".join(part):
        out.append(last)
    return out


def _front(file, kind: str, size: int) -> Iterator[bytes]:
    """A file from its first byte on; xz without its index, which a file that is still written does not have."""
    if kind != "xz":
        yield from chunks(file, kind, size, 0, size)
        return
    at, unpack = 0, None
    while at < size or unpack:
        file.seek(at)
        new = file.read(CHUNK) if unpack is None or unpack.needs_input else b""
        at += len(new)
        if unpack is None:
            new = new.lstrip(b"\0")  # padding between streams
            if not new:
                continue
            unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        elif unpack.needs_input and not new:
            raise EOFError("an xz stream has no end")
        if out := unpack.decompress(new, CHUNK):
            yield out
        if unpack.eof:
            at, unpack = at - len(unpack.unused_data), None
