"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set are the hashes of its distinct shingles. Sets are banded by size. For a band, the hash universe is cut
into ranges (segments): two linked sets differ in at most H tokens, so with segments of weight 1 (must agree) and
2 (may differ by one token, found through one-deletion neighbourhoods) that add up to more than H, one segment
agrees within its weight. The allocation of weights and the slack come from a cost model over the exact number of
sets in the band. The slack lets a set leave out up to that many segments that tell nothing: empty ones, and crowded ones, whose
signature more than HEAVY sets share. By the same count two linked sets agree in segments of weight slack + 1, less those
left out: pairs that meet in fewer buckets are no candidates.

Equal sets are one class from the start. Pairs are formed in buckets of at most HEAVY sets; sets with more crowded
segments than the slack allows meet in their crowded buckets over star edges. Candidates form groups (connected
components); each group is verified exactly on the whole sets, in blocks of BLOCK classes: every pair of a group is
counted in one of its block pairs, inside a task, and only links come out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common, shingles
from logloom.llm.components import components

WORDS, PERCENT = 4, 85
#: Growth of the size bands; sets that share a signature before it counts as heavy; classes in a verification block.
BAND, HEAVY, BLOCK = 1.4, 16, 800
#: Segments of a fine allocation for each that must agree; sets of the sample that tells hot keys, and how many of them make a key hot.
FINE, SAMPLE, HOT = 6, 8_192, 48
#: KIND, a long: bits of a signature. Flags; slack left + 1; the band; the segment (of doubles only).
DELETION, DOUBLE, MARK, LEFT, BAND_AT, SEGMENT = 1, 2, 4, 8, 32, 40
#: Row hashes that are broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 4_000_000


def bands(largest: int, growth: float = BAND) -> np.ndarray:
    """First size of each band."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out)


class Allocation:
    """Segments of one band: singles of weight 1, doubles of weight 2, and the slack.

    The cost of a set is its signature rows and the pairs it makes by chance: one for each other set that shares a token
    which is alone in its segment in both. A bucket makes pairs up to HEAVY sets only, which bounds the chance of a segment.
    A fine allocation has FINE singles for each one that must agree; only sets crowded in the first go by it.
    """

    def __init__(self, low: int, high: int, sets: int, percent: int = PERCENT, fine: bool = False):
        self.most = (100 - percent) * (high + 100 * high // percent) // (100 + percent)  # H: tokens that linked sets may differ in
        best = None
        for share in (0.0, 0.25, 0.5, 0.75, 1.0):
            for slack in range(64 + self.most // 4):
                units = self.most + 1 + slack
                doubles = int(units * share) // 2
                singles = units - 2 * doubles
                load = low / units
                empty = math.exp(-load)
                mean = singles * empty
                if mean + 5 * math.sqrt(mean * (1 - empty)) + self.most // 10 > slack + 0.5:
                    continue  # slack for nearly all sets' empty segments, and for some that a common passage fills
                rows = singles + doubles * (1 + 2 * load)
                partners = min(sets * load * empty / low, HEAVY)
                meetings = 0.05 * partners * (singles * load * empty + doubles * 4 * load * empty**3)
                cost = rows + meetings
                if best is None or cost < best[0]:
                    best = cost, units, doubles, slack
                break
        if best is None:
            best = 0, self.most + 1 + (self.most + 1) % 2, (self.most + 2) // 2, 0
        if fine:
            best = 0, FINE * (self.most + 1), 0, (FINE - 1) * (self.most + 1)
        _, self.units, self.doubles, self.slack = best
        edges = [(i * 2**64) // self.units for i in range(1, self.units)]
        self.cuts = np.array([e for i, e in enumerate(edges, 1) if i >= 2 * self.doubles or i % 2 == 0], np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sum_hash(h: np.ndarray, salt: int) -> np.ndarray:
    return shingles.mix(h ^ np.uint64(salt))


def class_keys(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(_signed(_sum_hash(h, 0x5DEECE66D).sum(dtype=np.uint64)[None])[0]), int(_signed(_sum_hash(h, 0x2545F4914F6CDD1D).sum(dtype=np.uint64)[None])[0])


def signatures(h: np.ndarray, band: int, plan: Allocation, fine: bool = False, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set in a band, and their kind, see KIND.

    Empty singles have no key, nor are hot keys told: both are taken off the slack, a double with a hot key by its
    weight. A set that has less slack than that is marked by one more row; in a fine allocation it tells its empty singles too.
    """
    values = shingles.mix(h + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    edges = np.concatenate([[0], np.searchsorted(h, plan.cuts), [len(h)]])
    size = np.diff(edges)
    salt = shingles.mix(np.arange(len(size), dtype=np.uint64) + np.uint64((band + 1 + 64 * fine) << 32))
    keys = shingles.mix((sums[edges[1:]] - sums[edges[:-1]]) ^ salt)
    n2 = plan.doubles
    left = plan.slack - int((size[n2:] == 0).sum())
    take = np.ones(len(size), bool)
    if left >= 0 or not fine:
        take[n2:] = size[n2:] > 0
    segment = np.zeros(len(size), np.int64)
    segment[:n2] = np.arange(n2)
    kind = np.zeros(len(size), np.int64)
    kind[:n2] += DOUBLE
    keys, kind, segment = keys[take], kind[take], segment[take]
    if n2:
        end = int(edges[n2])
        owner = np.repeat(np.arange(n2), size[:n2])
        whole = (sums[edges[1:]] - sums[edges[:-1]])[:n2][owner]
        keys = np.concatenate([keys, shingles.mix((whole - values[:end]) ^ salt[owner])])
        kind = np.concatenate([kind, np.full(end, DOUBLE + DELETION)])
        segment = np.concatenate([segment, owner])
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        is_hot = hot[at] == keys
        left -= int((is_hot & (kind == 0)).sum()) + 2 * len(np.unique(segment[is_hot & (kind > 0)]))
        keys, kind, segment = keys[~is_hot], kind[~is_hot], segment[~is_hot]
    kind = kind + (segment << SEGMENT) + (band << BAND_AT) + (max(left, -1) + 1) * LEFT
    if left < 0:
        mark = shingles.mix(keys[:1] ^ h[:1]) if len(keys) else h[:1]
        keys, kind = np.append(keys, mark), np.append(kind, MARK + (band << BAND_AT))
    return keys, kind


def bitmap(h: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits, at least one bit a hash and a power of two of them."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """A lower bound of the number of hashes in one of two sets only, from their bitmaps: a hash in both changes no bit of their sum."""
    if len(x) < len(y):
        x, y = y, x
    more, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        more = (more >> bits) ^ (more & ((1 << bits) - 1))
    return (more ^ int.from_bytes(y, "little")).bit_count()


def row_hash(doc_id: Column, text: Column) -> Column:
    """64 bits that stand for a row: rows of equal id and text have the same."""
    return F.xxhash64(doc_id.cast("long"), text)


def join_rows(docs: DataFrame, rows: DataFrame, n: int, how: str) -> DataFrame:
    """docs (column row) joined with a table of n row hashes (column node): broadcast up to BROADCAST_IDS, else shuffled."""
    return docs.join(F.broadcast(rows) if n <= BROADCAST_IDS else rows, F.col("row") == F.col("node"), how)


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Links between sets, as a matrix: between those in left and those in right (masks; both the same: all pairs)."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(k), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    held = np.diff(np.append(starts, len(tokens)))
    both = np.zeros(k * k, np.int64)
    for d in range(2, 9):
        rows = starts[held == d]
        if len(rows):
            own = owners[rows[:, None] + np.arange(d)]
            x, y = np.triu_indices(d, 1)
            both += np.bincount((own[:, x] * k + own[:, y]).ravel(), minlength=k * k)
    both = both.reshape(k, k)
    both = both + both.T
    rows = np.flatnonzero(held > 8)
    for i in range(0, len(rows), 4096):
        some = rows[i : i + 4096]
        m = np.zeros((len(some), k), np.float32)
        reps = held[some]
        at = np.repeat(starts[some], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        m[np.repeat(np.arange(len(some)), reps), owners[at]] = 1
        both += (m.T @ m).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    link = 100 * both >= percent * union
    np.fill_diagonal(link, False)
    side = left[:, None] & right[None, :]
    return link & (side | side.T)


def roots(link: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    k = len(link)
    label = np.arange(k)
    while True:
        near = np.where(link, label[None, :], k).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, heavy: int = HEAVY, with_rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (rows linked with it).

    Two documents link if their Jaccard similarity is at least percent / 100; documents without words link with
    nothing. Each row's text is compared, whatever its id. Rows of equal id count as one document in the graph, so an
    id that comes with several texts connects their components; null ids connect nothing, link as others do, and never
    name a component (component_id is null if nothing else is in it). An empty table gives an empty one.

    with_rows adds row (row_hash of the row), h1 and h2 (the class of its text) and group: the component by texts
    alone, which ids do not connect; null without words.
    """
    spark = docs.sparkSession
    common.ready(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", row_hash(F.col("doc_id"), F.col("text")))

    def summary(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, h1, h2 = [], [], []
            for i, h in enumerate(shingles.column_sets(batch.column(1), words)):
                a, b = class_keys(h)
                if len(h) == 1:  # a set of one shingle is known by one hash: its words are hashed anew
                    b = shingles.first_words(batch.column(1)[i].as_py(), words)
                n.append(len(h))
                h1.append(a)
                h2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "row", "n", "h1", "h2"])

    ids = common.materialise(docs.mapInArrow(summary, "doc_id bigint, row bigint, n bigint, h1 bigint, h2 bigint"), "sets")
    # a class is known by the least hash of its rows (rep) and named by its least id
    classes = common.materialise(ids.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "classes")

    # sets by size band, for the allocation
    largest = classes.agg(F.max("n")).first()[0] or 1
    lows = bands(largest)
    band_of = common.range_bin(F.col("n"), [int(x) for x in lows[1:]])
    in_band = {r["b"]: r["k"] for r in classes.groupBy(band_of.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    in_reach = [in_band.get(b, 0) + in_band.get(b + 1, 0) for b in range(len(lows) - 1)]

    def emit(fine: bool, hot: np.ndarray | None = None):
        """Signature rows of texts (row, text)."""
        plans = [Allocation(int(lows[b]), int(lows[b + 1]) - 1, k, percent, fine) for b, k in enumerate(in_reach)]

        def told(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                lengths = [len(x) for x in keys]
                arrays = [_signed(np.concatenate(keys)), np.repeat(np.array(own, np.int64), lengths), np.concatenate(kinds)]
                return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "rep", "kind"])

            for batch in rows:
                keys, own, kinds, size = [], [], [], 0
                for row, h in zip(batch.column(0).to_pylist(), shingles.column_sets(batch.column(1), words), strict=True):
                    if not len(h):
                        continue
                    least = -(-percent * len(h) // 100)
                    band = int(np.searchsorted(lows, len(h), "right")) - 1
                    while band >= 0 and lows[band + 1] - 1 >= least:
                        if plans[band].most > 0:
                            k, kind = signatures(h, band, plans[band], fine, hot)
                            keys.append(k)
                            own.append(row)
                            kinds.append(kind)
                            size += len(k)
                        band -= 1
                    if size > 100_000:
                        yield out()
                        keys, own, kinds, size = [], [], [], 0
                if keys:
                    yield out()

        return told

    # one row of each class is searched; rows of equal id and text have one hash and are made one
    several = ids.join(classes.where("copies > 1").select("h1", "h2", "rep"), ["h1", "h2"])
    several = common.materialise(several.groupBy("row", "rep").agg(F.count(F.lit(1)).alias("rows")).where("row <> rep OR rows > 1"), "copies")
    repeated = several.where("row = rep").select(F.col("row").alias("node"))
    n_several, n_repeated = several.count(), repeated.count()
    first_rows = join_rows(docs, several.select(F.col("row").alias("node")), n_several, "left_anti").select("row", "text")
    if n_repeated:
        first_rows = first_rows.unionByName(join_rows(docs, repeated, n_repeated, "left_semi").groupBy("row").agg(F.first("text").alias("text")))
    signature = "key bigint, rep bigint, kind bigint"
    flag = lambda bit: F.col("kind").bitwiseAND(bit) == bit
    band, left = F.shiftright("kind", BAND_AT).bitwiseAND(0xFF), F.shiftright(F.col("kind").bitwiseAND((1 << BAND_AT) - 1), 3) - 1
    double, deletion, marked = flag(DOUBLE), flag(DELETION), flag(MARK)
    crowded = F.col("sets") > heavy

    def met(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that meet in buckets of at most `heavy` sets (a, b); and sets (r, bd) that leave out more than their slack allows."""
        # a set's crowded segments only lower what it needs, as far as its slack reaches; by the slack, a double has its weight
        weight = F.count(F.when(~double, 1)) + 2 * F.size(F.collect_set(F.when(double, F.shiftright("kind", SEGMENT))))
        crowds = shared.where(crowded | marked).groupBy("rep", band.alias("band")).agg(weight.alias("n_crowded"), F.max(left).alias("left"), F.max(marked).alias("marked"))
        crowds = common.materialise(crowds.select(F.col("rep").alias("r"), F.col("band").alias("bd"), "n_crowded", (F.col("marked") | (F.col("n_crowded") > F.col("left"))).alias("dense")), "crowds")
        n_crowded = F.coalesce("n_crowded", F.lit(0))
        # two linked sets agree in segments of weight slack + 1 in all: so many that are neither empty, hot nor crowded
        need = F.when(n_crowded <= left, left + 1 - n_crowded).otherwise(0)
        few = shared.where(~crowded & ~marked).join(crowds, (F.col("rep") == F.col("r")) & (band == F.col("bd")), "left")
        few = few.select("key", "rep", band.alias("band"), deletion.alias("deletion"), F.when(double, 2).otherwise(1).alias("weight"), need.alias("need"))
        others = F.collect_list(F.struct("rep", "deletion", "need")).over(Window.partitionBy("key"))  # at most `heavy` of them
        each = few.withColumn("others", F.filter(others, lambda o: (o["rep"] < F.col("rep")) & ~(o["deletion"] & F.col("deletion")))).select("rep", "band", "weight", "need", F.explode("others").alias("o"))
        pairs = each.groupBy("rep", F.col("o.rep").alias("other"), "band").agg(F.sum("weight").alias("weight"), F.max(F.greatest("need", "o.need")).alias("need")).where("weight >= need")
        return pairs.select(F.col("rep").alias("a"), F.col("other").alias("b")), crowds.where("dense").select("r", "bd")

    # keys that many sets of a hash sample have are hot: they are left out as crowded without being counted
    n_classes = classes.count()
    drawn = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n_classes, 1)) * (1 << 30))
    hot = first_rows.where(drawn).mapInArrow(emit(False), signature).where(~marked).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).collect()
    hot = np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64))
    by_key = Window.partitionBy("key")
    told = first_rows.mapInArrow(emit(False, hot), signature)
    shared = told.withColumn("sets", F.count(F.lit(1)).over(by_key)).withColumn("whole", F.max(~deletion).over(by_key)).where((F.col("sets") > 1) & F.col("whole") | marked).drop("whole")
    shared = common.materialise(shared, "meetings")
    light, dense = met(shared)
    light = common.materialise(light.distinct(), "pairs")

    # sets whose crowded segments are too many meet again by a fine allocation, which may leave out more of them
    dense = common.materialise(dense.select("r").distinct(), "dense")
    again = join_rows(first_rows, dense.select(F.col("r").alias("node")), dense.count(), "left_semi").mapInArrow(emit(True), signature)
    fine_rows = common.materialise(again, "fine")
    counts = fine_rows.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").withColumnRenamed("key", "k")
    again = common.materialise(fine_rows.join(counts, F.col("key") == F.col("k"), "left").where(F.col("sets").isNotNull() | marked).drop("k"), "meetings")
    more, dense = met(again)
    light = light.unionByName(more).distinct()
    # a set that is dense still leaves out its most shared segments, as many as the slack allows: as all sets go by the same
    # order, the least shared of the segments that two linked sets agree in is left out by neither. There they meet by star edges
    most_shared = Window.partitionBy("rep", "bd").orderBy(F.desc("sets"), "key")
    held = again.where(crowded & ~marked).withColumn("left", left).join(dense, (F.col("rep") == F.col("r")) & (band == F.col("bd"))).withColumn("place", F.row_number().over(most_shared)).where("place > left").select("key", "rep")
    hubs = held.groupBy("key").agg(F.min("rep").alias("hub"))
    stars = held.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))

    # pairs that differ in too many bits differ in too many shingles
    def with_bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [(len(h), bitmap(h)) for h in shingles.column_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["row", "n", "bits"])

    def alike(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            columns = [c.to_pylist() for c in batch.columns]
            keep = [(100 + percent) * differ(x, y) <= (100 - percent) * (n + m) for n, x, m, y in zip(*columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    light = common.materialise(light, "pairs")
    ends = light.select(F.col("a").alias("node")).unionByName(light.select(F.col("b").alias("node"))).distinct()
    ends = common.materialise(ends, "ends")
    bits = common.materialise(join_rows(first_rows, ends, ends.count(), "left_semi").mapInArrow(with_bits, "row bigint, n bigint, bits binary"), "bits")
    pairs = light.join(bits.toDF("ra", "n", "x"), F.col("a") == F.col("ra")).join(bits.toDF("rb", "m", "y"), F.col("b") == F.col("rb"))
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "n", "x", "m", "y").mapInArrow(alike, "a bigint, b bigint")
    groups = components(pairs.unionByName(stars))
    common.release(shared, fine_rows, again, light, bits, ends)

    # exact verification of each group, in block pairs
    # groups of more than `block` classes are cut by set size first: only sizes within the threshold of each other meet
    class_lows = bands(largest, 1.12)
    class_highs = [int(x) - 1 for x in class_lows[1:]] + [2**62]
    size_class = common.range_bin(F.col("n"), [int(x) for x in class_lows[1:]])
    sized = groups.join(classes.select("rep", "copies", "n"), F.col("node") == F.col("rep")).select("node", "root", "copies", size_class.alias("size_class"))
    counts = sized.groupBy("root", "size_class").agg(F.count(F.lit(1)).alias("k"))
    plan = counts.groupBy("root").agg(F.sum("k").alias("members"), F.collect_list(F.struct("size_class", F.ceil(F.col("k") / block).cast("int").alias("blocks"))).alias("plan"))
    plan = plan.select(F.col("root").alias("g"), (F.col("members") > block).alias("split"), F.when(F.col("members") > block, F.col("plan")).otherwise(F.array(F.struct(F.lit(0).alias("size_class"), F.lit(1).alias("blocks")))).alias("plan"))
    members = common.materialise(sized.join(plan, F.col("root") == F.col("g")).drop("g"), "members")
    n_members = members.count()
    sets = join_rows(first_rows, members.select("node"), n_members, "left_semi")

    def with_sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [h.astype("<u8").tobytes() for h in shingles.column_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["row", "tokens"])

    own_class = F.when(F.col("split"), F.col("size_class")).otherwise(0)
    own_blocks = F.filter("plan", lambda p: p["size_class"] == own_class)[0]["blocks"]
    lows_at, highs_at = (F.from_json(F.lit(json.dumps([int(x) for x in v])), "array<bigint>") for v in (class_lows, class_highs))
    near = lambda p: 100 * F.element_at(highs_at, F.least(p["size_class"], own_class) + 1) >= percent * F.element_at(lows_at, F.greatest(p["size_class"], own_class) + 1)
    block_id = lambda c, h: c.cast("long") * (1 << 32) + h
    others = F.flatten(F.transform(F.filter("plan", near), lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda h: block_id(p["size_class"], h))))
    spread = (
        sets.mapInArrow(with_sets, "row bigint, tokens binary")
        .join(members, F.col("row") == F.col("node"))
        .withColumn("own", block_id(own_class, F.pmod(F.xxhash64("node"), own_blocks)))
        .withColumn("other", F.explode(others))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "tokens", "split")
    )
    dealt = spread.repartition(common.partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: list[tuple], i: int, j: int, split: bool) -> Iterator[tuple]:
            own = np.array([x[0] for x in group])
            link = verify([x[3] for x in group], own == i, own == j, percent)
            if link.any():
                weights = np.array([x[2] for x in group], np.int64)
                more, root = (link * weights[None, :]).sum(axis=1), roots(link)
                for x, n, r in zip(group, more.tolist(), root.tolist(), strict=True):
                    if n:
                        yield x[1], group[r][1], n, split

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, b, n, s = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.bool_())], ["a", "b", "links", "split"])

        at, group = None, []
        for batch in rows:
            found: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = r[0], r[1], r[2], r[7]
                if key != at:
                    if len(group) > 1:
                        found += links(group, at[1], at[2], at[3])
                    at, group = key, []
                group.append((r[3], r[4], r[5], np.frombuffer(r[6], "<u8")))
            yield out(found)
        if len(group) > 1:
            yield out(list(links(group, at[1], at[2], at[3])))

    links = common.materialise(dealt.mapInArrow(check, "a bigint, b bigint, links bigint, split boolean"), "links")
    apart = components(links.where("split").select("a", "b"))
    final = links.where("NOT split").select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(apart)
    degree = links.groupBy("a").agg(F.sum("links").alias("links"))
    final = common.materialise(final, "roots")
    # ids that come with several texts connect their classes
    texts_of = ids.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)))
    many = common.materialise(texts_of.where("min_h1 <> max_h1 OR min_h2 <> max_h2").select("doc_id"), "many-texts")
    united = final
    if many.count():
        own_classes = common.materialise(ids.where("n > 0").join(many, "doc_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct(), "many-classes")
        united = components(final.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(own_classes.join(own_classes.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")))
    united = united.select(F.col("node").alias("u"), F.col("root").alias("whole"))
    names = classes.join(united, F.col("rep") == F.col("u")).groupBy("whole").agg(F.min("least").alias("name"))
    named = (
        classes.join(final, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("a"), "left")
        .join(united.join(names, "whole"), F.col("rep") == F.col("u"), "left")
        .select("h1", "h2", F.when(F.col("whole").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("group"))
    )
    rows = ("row", "h1", "h2", "group") if with_rows else ()
    linked = ids.where("n > 0").join(named, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", *rows)
    alone = ids.where("n = 0").withColumn("group", F.lit(None).cast("long")).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), *rows)
    return linked.unionByName(alone)


def op6_ngram_join(spark, sf_dir):
    return jaccard_components(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i+3], ' '))) AS shingle FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root.component_id, coalesce(degree.links, 0)::BIGINT AS n_links
FROM documents d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
