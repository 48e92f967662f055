"""Token ids in Simple-8b coded files.

A 64-bit word holds a 4-bit selector and 60 bits: as many ids as fit at one width. Selector 15 is an escape: the
next word holds one id of up to 64 bits. Ids are coded in blocks of BLOCK ids; a segment (one row of the files, a
Parquet container that any Spark store can hold) lists each block's first word, so blocks decode independently and
all words of a segment decode with array operations. Segments end at document ends and hold SEGMENT ids or more,
documents in ascending id order within and across shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common
from logloom.llm.word_cache import Encoder

BLOCK, SEGMENT = 256, 1 << 16
#: Ids a word holds and their width, by selector. Fixed values of the Simple-8b layout; 0 is the escape, 15 a run of zeros.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, ZEROS = 0, 15
#: Bytes of words and their ids that a worker keeps (each with OVERHEAD for the objects); when full, the cache starts again.
CACHED, OVERHEAD = 256 << 20, 140
_encoders: dict[str, list] = {}


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 0 for 0."""
    if ids.max() < 2**53:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    out, rest = np.zeros(len(ids), np.int64), ids.astype(np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << shift)
        out[big] += shift
        rest[big] >>= np.uint64(shift)
    return (out + (rest > 0)).astype(np.int8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block of BLOCK ids."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    ids, need = ids.astype(np.uint64), widths(ids)
    room = np.resize(np.arange(BLOCK, 0, -1, dtype=np.int16), n)  # ids up to the block's end
    room[n - n % BLOCK :] -= (BLOCK - n % BLOCK) % BLOCK
    # how many ids from each place on fit into one word: the largest count whose window is narrow enough
    count, selector, todo = np.ones(n, np.int16), np.full(n, ESCAPE, np.int8), np.ones(n, bool)
    lowest, most = int(need.min()), int(need.max())
    for s in (ZEROS, *range(1, 15)):
        c, bits = int(COUNTS[s]), int(BITS[s])
        if bits < lowest:
            continue
        fits = np.flatnonzero(todo & (room >= c) & (need <= bits))
        if bits < most:
            if 4 * len(fits) < n:  # few: look at the next ids one after another
                for j in range(1, c):
                    if not len(fits):
                        break
                    fits = fits[need[fits + j] <= bits]
            else:
                wide = np.zeros(n + 1, np.int32)
                np.cumsum(need > bits, out=wide[1:])
                fits = fits[wide[fits + c] == wide[fits]]
        count[fits], selector[fits], todo[fits] = c, s, False
    # all blocks step through their ids side by side
    starts = np.arange(0, n, BLOCK)
    here, ends, head = starts, np.minimum(starts + BLOCK, n), np.zeros(n, bool)
    while len(here):
        head[here] = True
        here = here + count[here]
        on = here < ends
        here, ends = here[on], ends[on]
    first = np.flatnonzero(head)
    sel = selector[first]
    size = np.where(sel == ESCAPE, 2, 1)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[to] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        at, into = first[own], to[own]
        if s == ESCAPE:
            words[into + 1] = ids[at]
        elif s != ZEROS:
            word = words[into]
            for j in range(int(COUNTS[s])):
                word |= ids[at + j] << np.uint64(BITS[s] * j)
            words[into] = word
    return words, to[np.searchsorted(first, starts)].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of the blocks from first to stop (default: all)."""
    stop = len(offsets) if stop is None else stop
    if first >= stop:
        return np.empty(0, np.uint64)
    words = words[int(offsets[first]) : int(offsets[stop]) if stop < len(offsets) else len(words)]
    sel = (words >> np.uint64(60)).astype(np.int64)
    bare = np.zeros(len(words) + 1, bool)  # a word after an escape holds an id, not a selector
    for e in np.flatnonzero(sel == ESCAPE):
        if not bare[e]:
            bare[e + 1] = True
    heads = np.flatnonzero(~bare[:-1])
    sel = sel[heads]
    counts = COUNTS[sel]
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        own = sel == s
        if s == ESCAPE:
            out[to[own]] = words[heads[own] + 1]
        elif s != ZEROS:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNTS[s])):
                out[to[own] + j] = (words[heads[own]] >> np.uint64(BITS[s] * j)) & mask
    return out


def encode_texts(path: str, texts: list[bytes]) -> list[bytes]:
    """Ids of every UTF-8 text as little-endian 32-bit integers.

    Words between ASCII white space encode alone and are cached: this tokenizer drops white space, and neither its
    normalizer nor its merges reach over it. Case is folded first in ASCII texts, as the normalizer would, but where a
    text may hold a special string; other texts keep it, as the normalizer composes marks with capitals before.
    """
    if path not in _encoders:
        e = Encoder(path)
        if "Lowercase" not in str(e.library.normalizer) or "Removed" not in str(e.library.pre_tokenizer):
            raise ValueError("this tokenizer keeps case or white space: its texts can't be cut into words")
        _encoders[path] = [e, {}, 0]
    held = _encoders[path]
    encoder, cache, size = held
    words = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
    if size > CACHED:
        cache.clear()
        held[2] = 0
    fresh = list(set().union(*words).difference(cache))
    for i in range(0, len(fresh), 16_384):
        some = fresh[i : i + 16_384]
        ids, counts = encoder.ids([w.decode() for w in some])
        packed, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        held[2] += len(packed) + sum(map(len, some)) + OVERHEAD * len(some)
        cache.update(zip(some, (packed[a:b] for a, b in zip([0, *ends], ends)), strict=True))
    return [b"".join(map(cache.__getitem__, own)) for own in words]


SEGMENT_SCHEMA = "shard int, segment bigint, n_ids bigint, n_docs bigint, doc_counts binary, offsets binary, words binary, doc_ids array<{}>"


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each whole text, append end_id (None: nothing) and write the ids to files at path.

    Documents are range-partitioned by id (one shuffle of the texts) and sorted; null ids come first, repeated ids in
    the order of their texts, a null text is empty. Other columns are left out. An empty table writes no segment. Ids must be
    numbers: a column of another type raises ValueError.
    """
    spark = docs.sparkSession
    common.numeric(docs, id_col)
    common.ready(spark)
    n = common.partitions(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n) if n > 1 else F.array()).first()[0] or []
    ranged = docs.withColumn("shard", common.range_bin(F.col("doc_id"), sorted(set(cuts)))).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        size, shard, segment = 0, None, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            words, offsets = pack(ids)
            counts = np.array([len(x) // 4 for _, x in held], "<u4")
            row = [[shard], [segment], [len(ids)], [len(held)], [counts.tobytes()], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()], [[d for d, _ in held]]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), None]
        names = ["shard", "segment", "n_ids", "n_docs", "doc_counts", "offsets", "words", "doc_ids"]
        for batch in rows:
            types[-1] = pa.list_(batch.column(0).type)
            doc_ids, texts, shards = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            for i in range(0, len(texts), 256):
                for d, s, x in zip(doc_ids[i : i + 256], shards[i : i + 256], encode_texts(tokenizer, [t or b"" for t in texts[i : i + 256]]), strict=True):
                    if held and (size >= SEGMENT or s != shard):
                        yield flush()
                        held, size, segment = [], 0, segment + 1 if s == shard else 0
                    shard = s
                    held.append((d, x + tail))
                    size += len(x) // 4 + 1
        if held:
            yield flush()

    ranged.mapInArrow(run, SEGMENT_SCHEMA.format(kind)).write.option("compression", "uncompressed").parquet(path)


def read_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids
    adds ids (binary, little-endian 32-bit). Map-only but for the prefix sums over segments (a few numbers each)."""
    common.ready(spark)
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    shards = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row a shard
    base, total = [], 0
    for s in range(max(shards, default=-1) + 1):
        base.append(total)
        total += shards.get(s, 0)
    w = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))
    at = F.element_at(F.expr("array(" + ",".join(f"{x}L" for x in base or [0]) + ")"), F.col("shard") + 1)
    placed = segments.join(F.broadcast(starts) if sum(shards.values()) < 10**10 else starts, ["shard", "segment"]).select("doc_ids", "doc_counts", "offsets", "words", (at + F.col("before")).alias("before"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                doc_ids, counts = batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_py(), "<u4").astype(np.int64)
                ids = unpack(np.frombuffer(batch.column(3)[i].as_py(), "<u8"), np.frombuffer(batch.column(2)[i].as_py(), "<u4")).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                own = [ids[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [doc_ids, pa.array(batch.column(4)[i].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    path = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_files(spark, path)
