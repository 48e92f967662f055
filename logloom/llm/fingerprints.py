"""Document fingerprints by threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so sketches of any sizes compare and
merge, and containment of a short document in a long one can be estimated. A document with fewer than LEAST such
hashes keeps its LEAST smallest ones; the sketch states up to which hash it is whole, and two sketches compare below
the lower of their bounds, where both are whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logloom.llm import common, shingles

WORDS, FRACTION, LEAST = 5, 1 / 8, 32
_TOP = 2**64 - 1


class Sketch:
    """Sorted hashes, all there are up to bound."""

    __slots__ = ("bound", "hashes")

    def __init__(self, hashes: np.ndarray, bound: int):
        self.hashes, self.bound = hashes, bound

    @classmethod
    def of(cls, hashes: np.ndarray, fraction: float = FRACTION, least: int = LEAST) -> Sketch:
        """Of sorted distinct shingle hashes."""
        bound = int(_TOP * fraction) if fraction < 1 else _TOP
        n = int(np.searchsorted(hashes, np.uint64(bound), "right"))
        if n < least:
            if len(hashes) <= least:
                return cls(hashes, _TOP)
            return cls(hashes[:least], int(hashes[least]) - 1)
        return cls(hashes[:n], bound)

    def below(self, bound: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(bound), "right")]

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together."""
        bound = min(self.bound, other.bound)
        return Sketch(np.union1d(self.below(bound), other.below(bound)), bound)

    def counts(self, other: Sketch) -> tuple[int, int, int]:
        bound = min(self.bound, other.bound)
        a, b = self.below(bound), other.below(bound)
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; two empty documents are alike."""
        both, a, b = self.counts(other)
        if a + b:
            return both / (a + b - both)
        return float(not len(self.hashes) and not len(other.hashes))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this document's shingles that the other has; 1 for an empty document."""
        both, a, _ = self.counts(other)
        return both / a if a else float(not len(self.hashes))

    def text(self) -> str:
        return f"{self.bound:016x}:{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        bound, _, rest = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(rest), "<u8"), int(bound, 16))


def sketches(texts: list[str], fraction: float = FRACTION, least: int = LEAST, words: int = WORDS) -> list[Sketch]:
    return [Sketch.of(h, fraction, least) for h in shingles.distinct([t.encode() for t in texts], words)]


def fingerprints(docs: DataFrame, fraction: float = FRACTION, least: int = LEAST, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (text) of every row; a null text is empty. Map-only; other columns are left out."""
    common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [Sketch.of(h, fraction, least).text() for h in shingles.distinct(shingles.encoded(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, shard, extra), range-partitioned by id, one shard after another, sorted inside; the first
    row of each shard comes a second time (extra) at the end of the shard before it, and the very first at the end of
    the last shard: so each row's successor stands after it. One shuffle of the texts.

    Null ids come first; equal ids stand in the order of their texts. Ids must be numbers: a column of another type raises ValueError.
    """
    spark = docs.sparkSession
    common.numeric(docs, id_col)
    n = common.partitions(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n) if n > 1 else F.array()).first()[0] or []
    ranged = docs.withColumn("shard", common.range_bin(F.col("doc_id"), sorted(set(cuts))))
    # the first id of each shard that has rows: n numbers
    first = {r["shard"]: r for r in ranged.groupBy("shard").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()}
    full = sorted(first)
    before = {s: full[i - 1] for i, s in enumerate(full)}
    second = F.lit(None).cast("int")
    if full:
        table = "array(" + ",".join(str(before.get(s, -1)) for s in range(max(full) + 1)) + ")"
        least = "array(" + ",".join("CAST(NULL AS BIGINT)" if s not in first or first[s]["has_null"] else f"{first[s]['id']}L" for s in range(max(full) + 1)) + ")"
        is_first = F.col("doc_id").eqNullSafe(F.element_at(F.expr(least), F.col("shard") + 1))
        second = F.when(is_first, F.element_at(F.expr(table), F.col("shard") + 1))
    twice = ranged.withColumn("to", F.explode(F.when(second.isNull(), F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("extra")))).otherwise(F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("extra")), F.struct(second.alias("shard"), F.lit(True).alias("extra"))))))
    return twice.select("doc_id", "text", "to.shard", "to.extra").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "extra", "doc_id", "text")


def edited_likeness(docs: DataFrame, fraction: float = FRACTION, least: int = LEAST, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter of code points replaced by the start of the
    next document, ascending id), with near_edited and near_next: likeness to the edited and to the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty. A single document is its own next one. Null ids come first; equal ids stand in the order of their texts. Ids must be
    numbers: a column of another type raises ValueError.
    """
    common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of rows of one shard, each run ending with the row after its last one (or the shard's end)."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = (row[0], row[1] or "", row[2], row[3])
                if held and held[-1][2] != row[2]:
                    yield held
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                if size > 1 << 20 and len(held) > 1:
                    yield held
                    held, size = [row], len(row[1])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows_of(batches):
            # extra rows are the last of a shard: all of them but the first are repeats of one id and have had their turn
            real = [i for i, r in enumerate(held) if not r[3] and i + 1 < len(held)]
            if not real:
                continue
            texts = [r[1] for r in held]
            edited = []
            for i in real:
                n = len(texts[i])
                q = n // 4
                edited.append(texts[i][: n - q] + texts[i + 1][:q])
            own, changed = sketches(texts, fraction, least, words), sketches(edited, fraction, least, words)
            out = [
                (held[i][0], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), own[i].text(), c.text(), own[i].likeness(c), own[i].likeness(own[i + 1]))
                for i, e, c in zip(real, edited, changed, strict=True)
            ]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *map(pa.array, columns[1:])], names)

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir):
    return edited_likeness(common.table(spark, sf_dir, "documents"))
