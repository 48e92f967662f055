"""Clustering around centroids in whole numbers, with a LAESA table of distances to pivots.

Each vector's distances to a few fixed pivots are stored once, beside its whole-number components. In every round the
centroids' distances to the pivots are compared with them: by the triangle inequality the largest difference is a lower bound
of the distance between vector and centroid. Centroids that a bound rules out are not looked at; the others get their exact
distance in whole numbers. Bounds carry a margin for rounding, so they never change a result, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 40, 5, 64, 256, 2
#: Pivots, and the vectors that they are chosen from; only speed follows from them.
PIVOTS, SAMPLE = 12, 1_024
#: Largest component in whole numbers for which squared distances fit 64 bits.
LIMIT = 1 << 27
#: More than the rounding errors of three square roots of 64-bit numbers.
MARGIN = 1e-5
ROWS = 4_096


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, all finite numbers."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(column: pa.ListArray, dimensions: int, scale: int) -> np.ndarray:
    """(rows, dimensions) of floor(scale * component); ValueError beyond LIMIT."""
    out = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
    if out.size and np.abs(out).max() > LIMIT:
        raise ValueError(f"components reach beyond {LIMIT // scale}: squared distances don't fit 64 bits")
    return out.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (vectors, pivots)."""
    return np.sqrt(np.stack([squared(vectors, p[None]) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of a sample that lie far from each other: each next one has the largest sum of distances to those before."""
    if not len(sample):
        return sample
    picked = [0]
    total = np.sqrt(squared(sample, sample[:1]).astype(np.float64))
    while len(picked) < n:
        k = int(total.argmax())
        if total[k] <= 0:
            break
        picked.append(k)
        total += np.sqrt(squared(sample, sample[k][None]).astype(np.float64))
        total[picked] = -np.inf
    return sample[picked]


def assign(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (smallest number of equally near ones), squared distance, and how many distances were computed."""
    own = to_pivots(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(table[:, p, None] - own[None, :, p]), out=bound)
    bound -= MARGIN
    who = bound.argmin(axis=1)
    first = who.copy()
    best = squared(vectors, centroids[who])
    done = len(vectors)
    for k in np.argsort(bound.mean(axis=0), kind="stable").tolist():
        rows = np.flatnonzero((bound[:, k] <= np.sqrt(best)) & (first != k))
        if not len(rows):
            continue
        d = squared(vectors[rows], centroids[k][None])
        nearer = (d < best[rows]) | ((d == best[rows]) & (k < who[rows]))
        best[rows[nearer]], who[rows[nearer]] = d[nearer], k
        done += len(rows)
    return who, best, done


def _decoded(batch: pa.RecordBatch, dimensions: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, components and pivot distances of ROWS rows at a time."""
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        read = lambda j, kind, width: np.frombuffer(b"".join(part.column(j).to_pylist()), kind).reshape(part.num_rows, width)  # noqa: B023, E731
        yield part.column(0), read(1, "<i4", dimensions).astype(np.int64), read(2, "<f8", pivots)


def cluster(
    docs: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    salt: int = SALT,
    pivots: int = PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Components become floor(scale * x). The first centroids are the vectors with the smallest sha256 of "salt:id", in that order
    (equal ids: by components; null ids are never taken; fewer vectors than clusters: as many as there are, and with null ids only
    one centroid at the origin). In each round all vectors go to their nearest centroid, and each centroid that has any moves to
    the floor of their mean. Vectors that are null, of another length or with a null or non-finite component are left out;
    repeated rows count each; an empty table gives an empty one; other columns are left out. Components beyond LIMIT raise ValueError.

    The vectors are written once, with their pivot distances. A round is one job: each task sums its own clusters, and what the
    driver gets is one row a cluster."""
    spark = docs.sparkSession
    common.ready(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(usable(F.col("x"), dimensions))
    drawn = kept.orderBy(F.xxhash64(F.col("id").cast("string"), "x"), "x").limit(SAMPLE).select("x").toArrow().column(0).combine_chunks()
    fixed = choose_pivots(whole(drawn, dimensions, scale) if len(drawn) else np.zeros((0, dimensions), np.int64), pivots)
    if len(fixed) == 0:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                v = whole(part.column(1), dimensions, scale)
                d = to_pivots(v, fixed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in d.astype("<f8")], pa.binary())], ["id", "v", "d"])

    stored = common.materialise(kept.mapInArrow(prepare, f"id {kind}, v binary, d binary"), "centroids")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = stored.where(F.col("id").isNotNull()).select(key.alias("k"), "v").orderBy("k", "v").limit(clusters).collect()
    centres = np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in seeds], np.int64) if seeds else np.zeros((1, dimensions), np.int64)

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dimensions), np.int64)
            for batch in batches:
                for _, v, d in _decoded(batch, dimensions, len(fixed)):
                    who = assign(v, d, centres, fixed)[0]
                    order = np.argsort(who, kind="stable")
                    present, first = np.unique(who[order], return_index=True)
                    total[present] += np.add.reduceat(v[order], first, axis=0)
                    n += np.bincount(who, minlength=len(centres))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

        return run

    for _ in range(rounds):
        parts = stored.mapInArrow(sums(centres), "cluster int, n bigint, s array<bigint>")
        rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dimensions))).alias("s")).collect()  # one row a cluster
        centres = centres.copy()
        for r in rows:
            centres[r["cluster"]] = [x // r["n"] for x in r["s"]]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, d in _decoded(batch, dimensions, len(fixed)):
                who, best, _ = assign(v, d, centres, fixed)
                yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    assigned = common.materialise(stored.mapInArrow(last, f"id {kind}, cluster int, distance bigint"), "clustered", lasting=True)
    inertia = {r["cluster"]: r["i"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}  # one row a cluster
    common.release(stored)
    every = sum(inertia.values())
    facts = [(k, i, every, hashlib.sha256(",".join(map(str, centres[k].tolist())).encode()).hexdigest()) for k, i in sorted(inertia.items())]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.withColumnRenamed("id", id_col).join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, sf_dir):
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same by plain SQL: all distances of each round."""
    near = (
        "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.vec_id, k.v, m.c,"
        " list_sum(list_transform(list_zip(k.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, {0} m) GROUP BY vec_id, v"
    )
    steps = [
        f"raw AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS})",
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: floor({SCALE} * x)::BIGINT) AS v FROM raw WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('{SALT}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for r in range(1, ROUNDS + 1):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(f'm{r - 1}')})",
            f"s{r} AS MATERIALIZED (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY c, i)",
            f"n{r} AS MATERIALIZED (SELECT c, list((CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c)",
            f"m{r} AS MATERIALIZED (SELECT m.c, coalesce(n.m, m.m) AS m FROM m{r - 1} m LEFT JOIN n{r} n ON m.c = n.c)",
        ]
    steps.append(f"a AS MATERIALIZED ({near.format(f'm{ROUNDS}')})")
    return "WITH " + ",\n".join(steps) + (
        " SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(m.m, ',')) AS centroid_sha256 FROM a JOIN m{ROUNDS} m ON a.c = m.c"
    )


ORACLE = _oracle()
