"""Nearest neighbours by largest inner product, with multi-index hashing.

Vectors get binary codes: signs after learned rotations (iterative quantisation on a bounded sample, several
rotations side by side). Inner product becomes angle by one more coordinate that gives all rows the norm of the
longest. Codes are cut into substrings, each an index: a code within the Hamming radius of a query agrees with it in
some substring up to radius / substrings bits (pigeonhole), so probing all buckets that near, substring by substring,
retrieves every code within the radius. Retrieved codes are held against the radius and then ranked by the original
vectors in double precision. Queries are broadcast in waves of a fixed size; index rows are not shuffled, each task builds the
buckets of its rows and keeps its best k a query. What is shuffled is k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

#: Vectors that the rotations and the radius are learnt from, at most; queries among them.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
ROTATIONS, SUBSTRING = 4, 8
#: Share of the sample's true neighbours that the radius takes in.
WITHIN = 0.99
#: Index rows of a task at least; queries that are broadcast at once; share of the rows in a query's buckets from which all codes are compared.
INDEX_BLOCK, WAVE, SCANNED = 8_192, 32_768, 0.5
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal matrix R that brings the rows of x near the corners sign(x R)."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


class Codes:
    """Rotations, the longest norm and the radius."""

    def __init__(self, sample: np.ndarray, longest: float, k: int, rotations: int = ROTATIONS, within: float = WITHIN, queries: int = SAMPLE_QUERIES):
        self.longest = longest
        x = self.lifted(sample)
        x = x / self.longest
        self.rotations = np.concatenate([rotation(x, s) for s in range(rotations)], axis=1)
        bits = self.rotations.shape[1] // 8 * 8
        self.rotations = self.rotations[:, :bits] if bits else np.concatenate([self.rotations] * 8, axis=1)
        self.bits = self.rotations.shape[1]
        codes, q = self.of(sample), min(queries, len(sample))
        score = sample[:q] @ sample.T
        score[np.arange(q), np.arange(q)] = -np.inf
        best = np.argsort(-score, axis=1)[:, : max(1, min(k, len(sample) - 1))]
        away = np.bitwise_count(self.of_queries(sample[:q])[:, None, :] ^ codes[best]).sum(axis=2, dtype=np.int64)
        self.radius = int(np.quantile(away, within)) if len(sample) > 1 else self.bits

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of index rows, packed into bytes: substrings of 8 bits."""
        return np.packbits(self.lifted(x) @ self.rotations >= 0, axis=1)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ self.rotations >= 0, axis=1)


class Block:
    """Rows of the index: their codes, and for each substring the rows in the order of its value, with offsets: the buckets."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids, self.x, self.own = codes, ids, x, codes.of(x)
        columns = np.ascontiguousarray(self.own.T)
        self.rows = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        self.held = np.stack([np.bincount(c, minlength=256) for c in columns])
        self.offsets = np.concatenate([np.zeros((len(columns), 1), np.int64), np.cumsum(self.held, axis=1)], axis=1)
        # by pigeonhole a code within the radius agrees with the query's up to `step` bits in one of the substrings
        self.near = _NEAR <= codes.radius // len(columns)
        self.signs: np.ndarray | None = None

    def retrieved(self, asked: np.ndarray) -> np.ndarray:
        """For each code: how many rows its buckets hold, a row counted once a substring."""
        return (self.held @ self.near.T.astype(np.int64))[np.arange(asked.shape[1]), asked].sum(axis=1)

    def probe(self, code: np.ndarray) -> np.ndarray:
        """The rows in the buckets within `step` bits of a code, substring by substring."""
        parts = []
        for j, value in enumerate(code):
            for bucket in np.flatnonzero(self.near[value] & (self.held[j] > 0)):
                parts.append(self.rows[j, self.offsets[j, bucket] : self.offsets[j, bucket + 1]])
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)

    def away(self, asked: np.ndarray) -> np.ndarray:
        """Hamming distances of all rows from each of some codes."""
        if self.signs is None:
            self.signs = (2.0 * np.unpackbits(self.own, axis=1) - 1).astype(np.float32)
        return np.rint((self.codes.bits - (2.0 * np.unpackbits(asked, axis=1) - 1).astype(np.float32) @ self.signs.T) / 2).astype(np.int16)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, scanned: float = SCANNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score): the best k for each query; at least k rows are ranked, however far.

        Where a query's buckets hold more than a share `scanned` of the rows, all codes are held against the radius instead of
        those in the buckets: the same rows come out, and few would have been left out."""
        asked = self.codes.of_queries(queries)
        all_rows = self.retrieved(asked) > scanned * len(self.ids)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(~all_rows):
            rows = self.probe(asked[i])
            far = np.bitwise_count(self.own[rows] ^ asked[i]).sum(axis=1, dtype=np.int64)
            self._rank(out, query_ids[i], queries[i], rows[far <= self.codes.radius], asked[i], k)
        some = np.flatnonzero(all_rows)
        for i in range(0, len(some), 128):
            part = some[i : i + 128]
            within = self.away(asked[part]) <= self.codes.radius
            for r, q in enumerate(part):
                self._rank(out, query_ids[q], queries[q], np.flatnonzero(within[r]), asked[q], k)
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _rank(self, out: list, query_id: int, query: np.ndarray, rows: np.ndarray, code: np.ndarray, k: int) -> None:
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:  # too few so near: the nearest codes, retrieved or not
            every = np.bitwise_count(self.own ^ code).sum(axis=1, dtype=np.int64)
            every[self.ids == query_id] = self.codes.bits + 1
            rows = np.argsort(every, kind="stable")[:k]
            rows = rows[every[rows] <= self.codes.bits]
        score = (self.x[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        out.append((np.full(len(best), query_id), self.ids[rows][best], score[best]))


def best_of(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query."""
    query, ids, score = found
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], ids[keep], score[keep]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles): without vectors that are null, empty, zero or hold null or non-finite components,
    and without null ids; of several dimensions, the most frequent one (of equals, the lowest) takes part."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda e: e != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, index_block: int = INDEX_BLOCK, wave: int = WAVE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product): the k nearest found of each row whose id is divisible by
    `every`, among all other rows; ties go to the smaller id. Rows that usable() leaves out take no part. Repeated
    ids: a query never finds rows of its own id, and a repeated query id is asked once (one of its vectors). Other
    columns are left out; an empty table gives an empty result."""
    spark = vectors.sparkSession
    common.ready(spark)
    schema = "query_id bigint, vec_id bigint, score double"
    rows = usable(vectors, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    learnt = np.array([r["v"] for r in rows.where(draw < min(1.0, 1.0 * sample / n)).orderBy("vec_id").limit(sample + 1000).select("v").collect()], float)
    if len(learnt) < 2:
        learnt = np.array([r["v"] for r in rows.limit(2).select("v").collect()], float)
    codes = Codes(learnt, float(longest), k)
    # queries go in waves of at most `wave`, each broadcast; index rows stay where they are read, a task for at least `index_block` of them
    asks = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    waves = max(1, -(-asks.count() // wave))
    held = rows.select("vec_id", "v").coalesce(max(1, n // index_block))

    def against(asked: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries = asked.value
            parts: list[pa.RecordBatch] = []
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

            def one() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                t = pa.Table.from_batches(parts)
                x = t.column("v").combine_chunks()
                x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                found = Block(codes, t.column("vec_id").to_numpy(), x).search(query_ids, queries, k)
                return best_of(tuple(np.concatenate(c) for c in zip(best, found)), k)

            for batch in batches:
                if batch.num_rows:
                    parts.append(batch)
                if sum(p.num_rows for p in parts) >= 2 * index_block:
                    best, parts = one(), []
            if parts:
                best = one()
            for i in range(0, len(best[0]), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65_536]) for c in best], ["query_id", "vec_id", "score"])

        return run

    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = None
    for w in range(waves):
        own = asks.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(waves)) == w).select("vec_id", "v").toArrow()  # about `wave` rows
        if not own.num_rows:
            continue
        x = np.array(own.column("v").combine_chunks().flatten(), float).reshape(own.num_rows, -1)
        found = held.mapInArrow(against(spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), x))), schema)
        found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = found if waves == 1 else common.materialise(found, "nearest")
        answer = found if answer is None else answer.unionByName(found)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if answer is None else answer


def op8_vector_search(spark, sf_dir):
    return search(common.table(spark, sf_dir, "embeddings"))
