"""Runs of repeated words: a suffix automaton whose link tree is a link-cut tree that keeps last occurrences.

Words are appended one by one. The states on the path from the newest prefix to the root stand for all its suffixes; the
access of a link-cut tree walks that path in segments whose suffixes last ended at the same place, and gives all of them
the new end. Where a segment's longest suffix, of h words, ended d words ago and h >= d, a square of period d ends here,
and h + d words back to its start have that period: with h >= 3 * d these are (part of) a run of exponent 4 or more. Its
period is the smallest one, as the place d words ago was the last one, and it grows while it is met again at the next word.

A run of at least four periods repeats each of its four-word sequences, at a distance of a quarter of the run at most. So
only stretches of words that such sequences cover go through the automaton; which they are is told in numpy by hashes (equal
hashes of unlike words can only add a stretch).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm import common
from logloom.llm.shingles import encoded, mix

#: A run has so many words at least, and so many of its periods.
LEAST, EXPONENT = 6, 4
#: Words that are numbered and filtered together, in whole documents; a longer document stands alone.
TOGETHER = 200_000
#: Words of a sequence that must come again.
GRAM = 4
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

Run = tuple[int, int, int]


def automaton_runs(words: list[int]) -> list[Run]:
    """(start, length, period) of all runs of at least LEAST words and EXPONENT periods, by start, then period.

    Takes about n log n steps and some 600 bytes a word."""
    n = len(words)
    # the automaton: state 1 is the empty word, state 0 nothing
    to: list[dict[int, int]] = [{}, {}]
    size, link = [0, 0], [0, 0]
    # the link-cut tree: children in a path's splay tree, parent (in it, or of its top), end of the path (kept at the splay root)
    left, right, up, seen = [0, 0], [0, 0], [0, 0], [-1, -1]

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[y] == x) == (left[z] == y):
                turn(y)
                turn(x)
            else:
                turn(x)
                if inner:
                    turn(x)

    def turn(x: int) -> None:
        y = up[x]
        z = up[y]
        if left[y] == x:
            w = left[y] = right[x]
            right[x] = y
        else:
            w = right[y] = left[x]
            left[x] = y
        if w:
            up[w] = y
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x], up[y] = z, x
        seen[x] = seen[y]

    ends: dict[tuple[int, int], int] = {}
    newest = 1
    for i, c in enumerate(words):
        cur = len(to)
        to.append({})
        size.append(i + 1)
        link.append(1)
        left.append(0)
        right.append(0)
        seen.append(-1)
        p = newest
        while p and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        up.append(0)
        if p:
            q = to[p][c]
            if size[q] != size[p] + 1:
                copy = len(to)
                to.append(to[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                # the copy has the ends of q so far: it goes into the same path, right above q
                splay(q)
                above = left[q]
                left.append(above)
                right.append(0)
                if above:
                    up[above] = copy
                up.append(q)
                seen.append(seen[q])
                left[q] = copy
                link[q] = copy
                while p and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                q = copy
            link[cur] = q
        up[cur] = link[cur]
        newest = cur
        # access
        below, x = 0, cur
        while x:
            splay(x)
            last = seen[x]
            if last >= 0:
                d, h = i - last, size[x]
                if h >= (EXPONENT - 1) * d and h + d >= LEAST:
                    ends[i - h - d + 1, d] = i
            if (w := right[x]):
                seen[w] = last
            right[x] = below
            below, x = x, up[x]
        splay(cur)
        seen[cur] = i
    return [(s, e - s + 1, d) for (s, d), e in sorted(ends.items())] if n else []


def stretches(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that may hold a run, of documents that end at `ends`: no run lies anywhere else."""
    n = len(ids)
    if n < LEAST:
        return
    hashed = mix(ids.astype(np.uint64) + np.uint64(1))
    grams = sum((hashed[j : n - GRAM + 1 + j] * _PLACES[j] for j in range(1, GRAM)), hashed[: n - GRAM + 1] * _PLACES[0])
    begins = np.zeros(n + 1, bool)
    begins[0] = True
    begins[ends] = True
    document = np.cumsum(begins[:n])
    at = np.flatnonzero(document[: n - GRAM + 1] == document[GRAM - 1 :])
    if not len(at):
        return
    bits = np.uint64(n.bit_length())
    keys = mix(grams[at] + document[at].astype(np.uint64) * _PLACES[3])
    keys = np.sort((keys >> bits << bits) | at.astype(np.uint64))
    at = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    gap = np.where(keys[1:] >> bits == keys[:-1] >> bits, at[1:] - at[:-1], 4 * n)
    near = np.minimum(np.append(gap, 4 * n), np.insert(gap, 0, 4 * n))
    while True:
        at, near = at[near < 4 * n], near[near < 4 * n]
        if not len(at):
            return
        step = np.zeros(n + 1, np.int64)
        step[at] += 1
        np.add.at(step, at + GRAM, -1)
        covered = np.cumsum(step[:n]) > 0
        first = covered.copy()
        first[1:] &= ~covered[:-1] | begins[1:n]
        final = covered.copy()
        final[:-1] &= ~covered[1:] | begins[1:n]
        starts, stops = np.flatnonzero(first), np.flatnonzero(final) + 1
        length = stops - starts
        own = length[np.searchsorted(starts, at, "right") - 1]
        alive = (own >= LEAST) & (EXPONENT * near <= own)
        if alive.all():
            yield from zip(starts.tolist(), stops.tolist())
            return
        at, near = at[alive], near[alive]


def runs(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document's words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.fromiter((number[w] for d in documents for w in d), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    out: list[list[Run]] = [[] for _ in documents]
    for a, b in stretches(ids, ends):
        k = int(np.searchsorted(ends, a, "right"))
        base = a - int(ends[k] - lengths[k])
        out[k] += [(base + s, length, q) for s, length, q in automaton_runs(ids[a:b].tolist())]
    return out


def periodic_edit(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with their end made periodic, for a tenth of the ids: the planted cases of the query. A null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words without what repeats: of each run only its first period stays."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words), bool)
    for start, length, q in found:
        drop[start + q : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()])


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest exponent; of equal ones the first, then the one of the smaller period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_COLUMNS = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def find_runs(docs: DataFrame, edit: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and, of every row's words, the number of runs, the strongest one (nulls if there is none), and digests of all runs
    and of the words that are left without their repeats.

    A run is a stretch of at least LEAST words and EXPONENT periods that cannot be longer. Null and empty texts have no words;
    null ids and repeated rows come as they are; other columns are left out; an empty table gives an empty one. Map-only: a
    text is one task's work. edit: apply periodic_edit() first, which needs whole numbers as ids (else ValueError)."""
    common.ready(docs.sparkSession)
    if edit:
        common.numeric(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def result(group: list[list[bytes]]) -> list[tuple]:
        out = []
        for words, found in zip(group, runs(group), strict=True):
            best = strongest(found)
            listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            out.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = part.column(0).to_pylist() if edit else [None] * part.num_rows
                rows: list[tuple] = []
                group: list[list[bytes]] = []
                total = 0
                for doc_id, text in zip(ids, encoded(part.column(1)), strict=True):
                    words = text.split()  # of bytes: ASCII white space only
                    if edit:
                        words = periodic_edit(words, doc_id)
                    if group and total + len(words) > TOGETHER:
                        rows += result(group)
                        group, total = [], 0
                    group.append(words)
                    total += len(words)
                rows += result(group)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], [id_col, *_NAMES])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_COLUMNS}")


def op12_periodic_runs(spark, sf_dir):
    return find_runs(common.table(spark, sf_dir, "documents"), edit=True)
