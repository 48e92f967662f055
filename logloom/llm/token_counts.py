"""Token counts of whole texts without a shuffle of pre-tokens.

Texts are cut into pre-tokens: white space and the word after it. A byte-level vocabulary's own pre-tokenizer never
joins a word with the white space after it, so the token count of a text is the sum over its pre-tokens, special
strings included. Counts are looked up in two tiers: a broadcast table of frequent pre-tokens, as sorted hashes with their
bytes and lengths, which numpy searches for all pre-tokens of many texts at once (a hash that is found counts only where all
bytes are equal); then a cache per worker, whose misses the tokenizers library encodes, many a call. Which pre-tokens are
frequent is told by a bounded sample of the texts: only which tier answers depends on it, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import common
from logloom.llm.shingles import SLICE, byte_numbers, encoded, mix
from logloom.llm.word_cache import CACHE_BYTES, Encoder

#: Entries of the broadcast table (18 bytes each and their own bytes); texts it is learnt from, and the most bytes of one of them that are.
FREQUENT, SAMPLE, SAMPLE_BYTES = 50_000, 4_096, 1 << 16
#: White space as the vocabulary's pre-tokenizer sees it (the Unicode property), in UTF-8: single bytes, and lead bytes with what follows. Fixed values.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True
_LONG_BLANKS = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
_VALUES = np.random.default_rng(20250117).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_misses: dict[str, list] = {}


def blanks(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = _BLANK[buf]
    for lead, rests in _LONG_BLANKS.items():
        at = np.flatnonzero(buf == lead)
        for rest in rests if len(at) else ():
            hit = at[at + len(rest) < len(buf)]
            for i, b in enumerate(rest, 1):
                hit = hit[buf[hit + i] == b]
            for i in range(len(rest) + 1):
                out[hit + i] = True
    return out


def cut(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of buf (one also at each cut), and each byte's place in its pre-token."""
    blank = blanks(buf)
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[0] = True
    begins[cuts[cuts < len(buf)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))


def hashes(buf: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each pre-token."""
    return mix(np.add.reduceat(_VALUES[buf] * byte_numbers(places), starts))


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SLICE bytes: bytes, ends of the parts in them, and the text that each part is of. Texts longer than that
    are cut where white space follows a word; a word longer than that stays whole."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > SLICE:
                buf = np.frombuffer(t, np.uint8, offset=at)
                k = SLICE
                while True:
                    now = buf[:k]
                    near = np.flatnonzero(_BLANK[now[1:]] & ~_BLANK[now[:-1]] & (now[:-1] < 0x80))
                    if len(near) or k >= len(buf):
                        break
                    k *= 2  # a word longer than a slice
                end = at + int(near[-1]) + 1 if len(near) else len(t)
            if size and size + end - at > SLICE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners)
                parts, owners, size = [], [], 0
            parts.append(t[at:end])
            owners.append(i)
            size += end - at
            at = end
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners)


class Table:
    """Frequent pre-tokens as sorted hashes, their bytes one after another, and numbers of tokens."""

    def __init__(self, pieces: list[bytes], lengths: np.ndarray):
        found = []
        for p in pieces:
            buf = np.frombuffer(p, np.uint8)
            starts, places = cut(buf, np.empty(0, np.int64))
            if len(starts) != 1:
                raise ValueError("an entry is more than one pre-token")
            found.append(hashes(buf, starts, places)[0])
        first = np.array(found, np.uint64)
        order = np.argsort(first, kind="stable")
        self.first, self.lengths = first[order], np.asarray(lengths, np.uint16)[order]
        sizes = np.array([len(pieces[k]) for k in order.tolist()], np.int64)
        self.bytes, self.ends = np.frombuffer(b"".join(pieces[k] for k in order.tolist()), np.uint8), np.cumsum(sizes)
        self.sizes = sizes

    def find(self, buf: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of buf, -1 where the table has none."""
        if not len(self.first):
            return np.full(len(starts), -1, np.int64)
        first = hashes(buf, starts, places)
        sizes = np.diff(np.append(starts, len(buf)))
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        hit = (self.first[at] == first) & (self.sizes[at] == sizes)
        # a hash may be of other bytes
        begins = np.where(hit, self.ends[at] - self.sizes[at], 0)
        expected = self.bytes[np.where(np.repeat(hit, sizes), np.repeat(begins, sizes) + places, 0)]
        unlike = np.add.reduceat((expected != buf).astype(np.int64), starts) > 0
        return np.where(hit & ~unlike, self.lengths[at].astype(np.int64), -1)


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: int = FREQUENT, sample: int = SAMPLE) -> list[bytes]:
    """The most frequent pre-tokens of about `sample` texts, drawn by hash: of each at most the first SAMPLE_BYTES. Each task counts its
    own, in one job; the driver gets the `table` most frequent ones."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in rows:
            for t in batch.column(0).to_pylist():
                if t:
                    buf = np.frombuffer(t, np.uint8)
                    starts = cut(buf, np.empty(0, np.int64))[0].tolist()
                    seen.update(t[a:b] for a, b in zip(starts[:-1], starts[1:]))  # the last may have been cut
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    text = F.substring(F.col(text_col).cast("binary"), 1, SAMPLE_BYTES)
    best = []
    for r in docs.where(draw & F.col(text_col).isNotNull()).select(text.alias("t")).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table).collect():
        best.append(bytes(r["piece"]))
    return best


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", table: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row; null texts are empty. Repeated
    rows and null ids come as they are; other columns are left out. Special strings inside texts count as the
    library's default has them. Raises ValueError if the tokenizer is not byte-level without a normalizer."""
    spark = docs.sparkSession
    common.ready(spark)
    encoder = Encoder(path)
    if encoder.library.normalizer is not None or "ByteLevel" not in str(encoder.library.pre_tokenizer):
        raise ValueError("only byte-level tokenizers without a normalizer count by pre-tokens")
    top = frequent(docs, id_col, text_col, table, sample)
    lengths = encoder.ids([p.decode() for p in top])[1] if top else np.empty(0, np.int64)
    top, lengths = [p for p, n in zip(top, lengths) if n < 1 << 16], lengths[lengths < 1 << 16]
    first_tier = spark.sparkContext.broadcast(Table(top, lengths))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _misses:
            _misses[path] = [Encoder(path), {}, 0]
        worker, known = _misses[path], first_tier.value
        for batch in rows:
            texts = encoded(batch.column(1))
            totals = np.zeros(len(texts), np.int64)
            for buf, ends, owners in slices(texts):
                starts, places = cut(buf, ends)
                n = known.find(buf, starts, places)
                missed = np.flatnonzero(n < 0)
                if len(missed):
                    n[missed] = _missing(worker, buf, starts, missed)
                totals += np.bincount(owners[np.searchsorted(ends, starts, "right")], weights=n, minlength=len(texts)).astype(np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(totals), pa.array(totals > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _missing(worker: list, buf: np.ndarray, starts: np.ndarray, missed: np.ndarray) -> np.ndarray:
    """Tokens of pre-tokens that the table lacks: from the worker's cache (pieces to tokens, its bytes counted), else by the library."""
    encoder, cache, _ = worker
    data, to = buf.tobytes(), np.append(starts, len(buf))
    pieces = [data[a:b] for a, b in zip(to[missed].tolist(), to[missed + 1].tolist())]
    if worker[2] > CACHE_BYTES:
        cache.clear()
        worker[2] = 0
    fresh = [p for p in dict.fromkeys(pieces) if p not in cache]
    for i in range(0, len(fresh), 4096):
        some = fresh[i : i + 4096]
        cache.update(zip(some, encoder.ids([p.decode() for p in some])[1].tolist(), strict=True))
        worker[2] += sum(map(len, some)) + 120 * len(some)
    return np.array([cache[p] for p in pieces], np.int64)


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
