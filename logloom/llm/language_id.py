"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions and gives every position a distribution over the
languages; a document's probabilities are the mean over all its positions. It is trained on the driver, in numpy, by
backpropagation through time, on short pieces of a bounded sample of labelled documents. Texts are read whole, as
windows of WINDOW bytes side by side (the state starts anew at each window), so memory does not follow text length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

UNDETERMINED = "und"
HIDDEN, WINDOW, SIDE_BY_SIDE = 6, 128, 2048
#: The sample that is learnt from: documents a language, languages * documents at most, pieces of a document, characters of a piece.
PER_LANGUAGE, SAMPLE, PIECES, PIECE_CHARS = 600, 12_000, 3, 64
STEPS, BATCH, RATE = 500, 160, 0.02
_letter = re.compile(r"[^\W\d_]").search


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ByteGru:
    """Parameters of each direction: table (3H, 256) of input parts, u (3H, H), c (H, 1); of the output: v (K, 2H), b (K, 1).

    z, r = sigmoid; n = tanh(table_n + r * (u_n h + c)); h' = n + z * (h - n)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.languages, self.hidden = languages, h
        self.p = {}
        for d in ("f", "b"):
            self.p["table" + d] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["c" + d] = np.zeros((h, 1), np.float32)
        self.p["v"] = rng.normal(0, 0.3, (len(languages), 2 * h)).astype(np.float32)
        self.p["b"] = np.zeros((len(languages), 1), np.float32)

    # training

    def _run(self, d: str, x: np.ndarray) -> list[tuple]:
        """States of one direction over x (T, B), for the way back."""
        table, u, c, h = self.p["table" + d], self.p["u" + d], self.p["c" + d], self.hidden
        state, kept = np.zeros((h, x.shape[1]), np.float32), []
        for row in x:
            a, own = u @ state, table[:, row]
            zr = _sigmoid(a[: 2 * h] + own[: 2 * h])
            z, r, g = zr[:h], zr[h:], a[2 * h :] + c
            n = np.tanh(own[2 * h :] + r * g)
            kept.append((state, z, r, g, n))
            state = n + z * (state - n)
            kept[-1] += (state,)
        return kept

    def _back(self, d: str, x: np.ndarray, kept: list[tuple], down: np.ndarray, grad: dict) -> None:
        u, h = self.p["u" + d], self.hidden
        du, dc, dx = np.zeros_like(u), np.zeros((h, 1), np.float32), np.empty((len(x), 3 * h, x.shape[1]), np.float32)
        later = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, g, n, _ = kept[t]
            dh = down[t] + later
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr, dg = dh * (before - n) * z * (1 - z), dn * g * r * (1 - r), dn * r
            da = np.concatenate([dz, dr, dg])
            dx[t] = np.concatenate([dz, dr, dn])
            du += da @ before.T
            dc += dg.sum(axis=1, keepdims=True)
            later = dh * z + u.T @ da
        flat = np.ascontiguousarray(dx.transpose(1, 0, 2)).reshape(3 * h, -1)
        grad["table" + d] = np.stack([np.bincount(x.ravel(), row, 256) for row in flat]).astype(np.float32)
        grad["u" + d], grad["c" + d] = du, dc

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the masked positions of x (T, B), each labelled with its column's y; its gradient."""
        h, grad = self.hidden, {}
        forth, back = self._run("f", x), self._run("b", x[::-1])
        states = np.stack([np.concatenate([forth[t][5], back[len(x) - 1 - t][5]]) for t in range(len(x))])  # T, 2H, B
        logits = np.einsum("kh,thb->tkb", self.p["v"], states, optimize=True) + self.p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        prob = e / e.sum(axis=1, keepdims=True)
        columns, total = np.arange(x.shape[1]), mask.sum()
        loss = -float((np.log(prob[:, y, columns] + 1e-12) * mask).sum() / total)
        prob[:, y, columns] -= 1
        prob *= (mask / total)[:, None, :]
        grad["v"] = np.einsum("tkb,thb->kh", prob, states, optimize=True).astype(np.float32)
        grad["b"] = prob.sum(axis=(0, 2), dtype=np.float32)[:, None]
        down = np.einsum("kh,tkb->thb", self.p["v"], prob, optimize=True).astype(np.float32)
        self._back("f", x, forth, down[:, :h], grad)
        self._back("b", x[::-1], back, down[::-1, h:], grad)
        return loss, grad

    def train(self, pieces: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        """Adam on batches that hold all languages alike."""
        rng = np.random.default_rng(seed)
        t = max(map(len, pieces))
        x = np.zeros((t, len(pieces)), np.uint8)
        mask = np.zeros((t, len(pieces)), np.float32)
        for i, p in enumerate(pieces):
            x[: len(p), i] = np.frombuffer(p, np.uint8)
            mask[: len(p), i] = 1
        own = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, max(1, batch // len(own))) for o in own if len(o)])
            _, grad = self.gradient(x[:, pick], mask[:, pick], labels[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    # use

    def _direction(self, d: str, x: np.ndarray, logits: np.ndarray, v: np.ndarray) -> None:
        """Adds v @ state to logits (T, K, B) at every position; all gates go through tanh, with halves folded in."""
        h, b = self.hidden, x.shape[1]
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5
        u = self.p["u" + d] * 0.5  # z and r: half inside the tanh; n: half of 0.5 * (1 + tanh) * g
        table = np.ascontiguousarray(self.p["table" + d] * half)
        c = self.p["c" + d] * np.float32(0.5)
        state = np.zeros((h, b), np.float32)
        a, own = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        zr, g, n, part = a[: 2 * h], a[2 * h :], own[2 * h :], np.empty((h, b), np.float32)
        out = np.empty((len(v), b), np.float32)
        for t, row in enumerate(x):
            np.take(table, row, axis=1, out=own, mode="clip")
            np.matmul(u, state, out=a)
            zr += own[: 2 * h]
            np.tanh(zr, out=zr)
            g += c
            np.multiply(zr[h:], g, out=part)
            part += g
            n += part
            np.tanh(n, out=n)
            state -= n
            state *= np.float32(0.5)
            np.multiply(zr[:h], state, out=part)
            state += part
            state += n
            np.matmul(v, state, out=out)
            logits[t] += out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, K, B) of every position of the windows x (T, B)."""
        h = self.hidden
        logits = np.empty((len(x), len(self.languages), x.shape[1]), np.float32)
        logits[:] = self.p["b"]
        self._direction("f", x, logits, np.ascontiguousarray(self.p["v"][:, :h]))
        self._direction("b", x[::-1], logits[::-1], np.ascontiguousarray(self.p["v"][:, h:]))
        np.clip(logits, -30, 30, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes], window: int = WINDOW, side_by_side: int = SIDE_BY_SIDE) -> np.ndarray:
        """Mean probabilities (documents, K); zeros for empty texts."""
        sums = np.zeros((len(texts), len(self.languages)))
        lengths = np.array([len(t) for t in texts], np.int64)
        windows = -(-lengths // window)
        owner = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        for i in range(0, len(owner), side_by_side):
            own, at = owner[i : i + side_by_side], place[i : i + side_by_side]
            full = np.minimum(lengths[own] - at * window, window)
            x = np.full((len(own), window), 32, np.uint8)
            for j, (o, a, n) in enumerate(zip(own.tolist(), (at * window).tolist(), full.tolist(), strict=True)):
                x[j, :n] = np.frombuffer(texts[o], np.uint8, n, a)
            p = self.positions(np.ascontiguousarray(x.T))
            if (full < window).any():
                p *= (np.arange(window)[:, None] < full[None, :])[:, None, :]
            np.add.at(sums, own, p.sum(axis=0).T)
        return sums / np.maximum(lengths, 1)[:, None]

    def labels(self, text: str, window: int = WINDOW) -> list[str]:
        """The most likely language at every byte of a text."""
        data = text.encode()
        x = np.full((-(-len(data) // window), window), 32, np.uint8)
        x.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
        best = self.positions(np.ascontiguousarray(x.T)).argmax(axis=1).T.reshape(-1)[: len(data)]
        return [self.languages[k] for k in best]


def held_out(doc_id) -> object:
    """Documents whose label is never learnt from: CRC-32 of the id's decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, hidden: int = HIDDEN, steps: int = STEPS) -> ByteGru | None:
    """A network for the labels of the documents that are not held out; None if there are none.

    Learns from a hash sample of about per_language documents a language (never more than 2 * sample rows, whatever ids
    repeat), PIECES pieces of PIECE_CHARS characters each, from places all over the text."""
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r["l"]: r["n"] for r in known.groupBy(F.col(label_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts, key=lambda k: (-counts[k], k))[:sample]
    each = max(1, min(per_language, sample // len(languages)))
    share = {k: min(1.0, 1.2 * each / counts[k]) for k in languages}
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value in sorted(set(share.values())):
        rate = F.when(F.col(label_col).isin([k for k in languages if share[k] == value]), value).otherwise(rate)
    n = F.length(text_col)
    spots = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(100 + i)), F.greatest(n - PIECE_CHARS, F.lit(1))) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)]
    rows = known.where(draw < rate).select(F.col(id_col).cast("string").alias("i"), F.col(label_col).alias("l"), *(s.alias(f"p{k}") for k, s in enumerate(spots)), F.xxhash64(text_col).alias("h"))
    rows = rows.orderBy("h", "i").limit(2 * sample).drop("h").collect()
    index = {k: i for i, k in enumerate(languages)}
    found = sorted((p, r["l"], r["i"] or "") for r in rows for p in list(r)[2:] if p and _letter(p))
    if not found:
        return None
    model = ByteGru(languages, hidden)
    model.train([p.encode() for p, _, _ in found], np.array([index[k] for _, k, _ in found]), steps)
    return model


def identify(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score (0 to 1: mean probability of lang_pred over all positions), and the columns in `keep`.

    A null text, one without letters, and every text if there is no model, get lang_pred 'und' and score 0. Rows come
    out as they went in; an empty table gives an empty one. Map-only. Columns in `keep` may have any name but those of the
    result's other columns, else ValueError.
    """
    common.kept(keep, (id_col, "lang_pred", "score"))
    common.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    extra = [docs.schema[k] for k in keep]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [t if t and _letter(t) else "" for t in part.column(1).to_pylist()]
                if model is None:
                    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                else:
                    p = model.documents([t.encode() for t in texts])
                    best = p.argmax(axis=1)
                    names = [model.languages[k] if t else UNDETERMINED for k, t in zip(best.tolist(), texts, strict=True)]
                    scores = np.clip(p[np.arange(len(best)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *part.columns[2:]], [id_col, "lang_pred", "score", *keep])

    schema = f"`{id_col}` {kind.simpleString()}, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def op2_language_id(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
