"""SentencePiece encoding and decoding for merge-type vocabularies.

encode() joins adjacent symbol pairs by an agenda ordered by score, best first and leftmost among equals. A text is
cut where no vocabulary piece can reach over: at line feeds (if no piece holds one), where a space follows another
character (no piece may have one there) and before marks that no piece has after a letter or digit. Such cuts are found from the vocabulary, so
each cut piece is encoded alone and cached per worker. Every Arrow batch is checked against the sentencepiece
library: all pieces that were new to the worker's cache go through both, and a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm import common

#: Bytes of cached cut pieces a worker keeps; when full, the cache starts again.
CACHE_BYTES = 96 << 20
#: Characters of the texts that one call of the library decodes.
DECODE_CHARS = 1 << 20
#: Longest cut piece, in characters, whose agenda is a plain list.
SHORT = 48
NEVER = float("inf")
_SPACE = "▁"
_models: dict[str, Agenda] = {}


class Agenda:
    """One vocabulary with its scores."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}.get
        if len(self.bytes_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character: texts can't be cut at spaces")
        # a cut piece: its spaces, then what follows up to the next space, line feed, or a mark that no piece has after a letter or digit
        line = "" if any("\n" in p for p in self.ids) else "\n"
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = re.escape("".join(sorted(set(",.!?;:|") - joined))) or "\0"
        self.cut = re.compile(f"[ {_SPACE}]*[^\\W_]++(?=[{marks}])|[ {_SPACE}]*[^ {_SPACE}{line}]+|[ {_SPACE}]+" + (f"|{line}" if line else "")).findall
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def merge(self, text: str) -> list[int]:
        """Ids of one cut piece, spaces written as U+2581: the agenda is a list for short pieces, a heap for long ones."""
        out: list[int] = []
        for s in self.merge_short(text) if len(text) <= SHORT else self.merge_long(text):
            at = self.ids.get(s)
            if at is not None:
                out.append(at)
            else:
                out += [self.bytes_id[b] for b in s.encode()]
        return out

    def merge_short(self, text: str) -> list[str]:
        symbols, cost = list(text), self.cost
        agenda = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost among equals
            joined = symbols[i] + symbols.pop(i + 1)
            symbols[i] = joined
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(joined + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + joined, NEVER)
        return symbols

    def merge_long(self, text: str) -> list[str]:
        symbols: list[str | None] = list(text)
        n, cost = len(symbols), self.cost
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(text[i] + text[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or len(a) + len(b) != size or right[i] != j:
                continue  # one of the two has been joined meanwhile
            symbols[i], symbols[j] = a + b, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (c := cost(p := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(agenda, (c, x, y, len(p)))
        return [s for s in symbols if s is not None]

    def learn(self, fresh: list[str]) -> None:
        """Encode cut pieces that the cache lacks, and hold them against the library."""
        mine = [self.merge(p.replace(" ", _SPACE)) for p in fresh]
        # the library puts a space before every text: a piece that starts with one goes without it, another after a line feed
        plain = [p[1:] if p[0] in f" {_SPACE}" else "\n" + p for p in fresh]
        skip = [0 if p[0] in f" {_SPACE}" else len(self.library.encode("\n")) for p in fresh]
        for p, ids, theirs, k in zip(fresh, mine, self.library.encode(plain, num_threads=1), skip, strict=True):
            if p in (" ", _SPACE):
                theirs, k = [self.ids[_SPACE]], 0
            if ids != theirs[k:]:
                raise ValueError(f"the agenda and the library differ on {p!r}: {ids} and {theirs[k:]}")
            self.cache[p] = packed = array("I", ids).tobytes()
            self.cached += 100 + 2 * len(p) + len(packed)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers, without begin and end."""
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        cuts = [self.cut(" " + t) if t else [] for t in texts]
        fresh = set().union(*cuts).difference(self.cache)
        if fresh:
            self.learn(sorted(fresh))
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cuts]


def model(path: str) -> Agenda:
    if path not in _models:
        _models[path] = Agenda(path)
    return _models[path]


def slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, with_ids: bool = False) -> DataFrame:
    """Encode each whole text, then decode the ids.

    Returns id_col, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256; with_ids adds
    ids (binary, little-endian 32-bit) and decoded. A null text counts as empty (only begin and end ids); repeated
    rows and null ids are returned as they come; other columns are left out. An empty table gives an empty one.
    Map-only: no shuffle.
    """
    common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        sp = m.library
        head = np.array([sp.bos_id()] * begin, "<u4").tobytes()
        tail = np.array([sp.eos_id()] * end, "<u4").tobytes()
        for batch in rows:
            counts, hashes, decoded_hashes, kept, decoded_kept = [], [], [], [], []
            for texts in slices([t or "" for t in batch.column(1).to_pylist()], DECODE_CHARS):
                ids = [head + x + tail for x in m.encode(texts)]
                decoded = sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                counts += [len(x) // 4 for x in ids]
                hashes += [hashlib.sha256(x).hexdigest() for x in ids]
                decoded_hashes += [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                if with_ids:
                    kept += ids
                    decoded_kept += decoded
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(kept, pa.binary()), pa.array(decoded_kept, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
