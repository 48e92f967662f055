"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between the tags of block elements, each with the path of
elements that are open around it. A block's vector is the sum of learnt vectors of its hashed path parts (tags, words of
classes and ids), the mean of learnt vectors of its hashed words, and a few measures. A bidirectional LSTM reads the whole
sequence of vectors and gives each block a probability of belonging to the article. Its weights are learnt on the driver, in
numpy, by backpropagation through time, from a bounded sample: pages of the table whose own elements tell (article, main,
nav, footer and the like), and made-up pages of many layouts, whose texts are drawn from the sampled ones. Path parts are left
out at random while learning, so that texts and neighbours count as well.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

#: Pages of the sample, blocks of one that are learnt from (its first and last ones); made-up pages.
SAMPLE, FIRST_BLOCKS, LAST_BLOCKS, MADE_UP = 300, 30, 18, 2_000
#: Hash buckets of path parts and words, sizes of their vectors, measures of a block, states of each direction.
PATH_CELLS, WORD_CELLS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 1 << 12, 1 << 13, 16, 8, 6, 16
STEPS, BATCH, RATE, DROPPED = 800, 32, 0.01, 0.12
#: Words of a block that are learnt from.
WORDS_LEARNT = 60
#: Blocks of pages that are labelled together, about.
TOGETHER = 20_000

# What HTML says of elements. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an opening tag closes, and what holds it back.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ()), "thead": ("tr td th tbody", ("table",)), "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th tbody", ("table",))}

_TAG = re.compile(
    r"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)"  # a comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"  # a tag
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"  # one whose quotes do not match, or that never ends
    r"|<[!?/][^>]*+(?:>|\Z)"
)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.!?。！？](?:\s|$)")
_MARK = re.compile(r"""\sdata-main="([01])\"""")


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@functools.lru_cache(10_000)
def _own_parts(name: str, attributes: str) -> tuple[str, ...]:
    """Path parts of an element: its tag, words of its class, id and role."""
    named = _NAMED.findall(attributes) if "=" in attributes else ()
    return (name, *("." + w.lower() for _, a, b, c in named for w in _PARTS.findall(a or b or c)))


class Block:
    """Text of a leaf block, the path parts around it, the share of its text inside links, and (made-up pages) its label."""

    __slots__ = ("text", "path", "linked", "label")

    def __init__(self, text: str, path: tuple[str, ...], linked: float, label: int | None):
        self.text, self.path, self.linked, self.label = text, path, linked, label


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in order: character references decoded, white space turned into one blank.

    Scripts, styles, other elements without text of the page, comments and the head are passed over; tags that are not closed end
    where HTML lets them end."""
    out: list[Block] = []
    names: list[str] = []  # open elements
    parts: list[tuple[str, ...]] = []  # path parts of each and of all around it
    labels: list[int | None] = []  # likewise
    pieces: list[str] = []
    linked = in_link = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            clean = html.unescape(raw) if "&" in raw else raw
            pieces.append(clean)
            if in_link:
                linked += len(clean)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = "".join(pieces)
            clean = " ".join(whole.split())
            if clean and "head" not in names:
                leaf = next((n for n in reversed(names) if n not in INLINE), "")
                out.append(Block(clean, (*(parts[-1] if parts else ()), "leaf " + leaf), min(1.0, linked / len(whole)), labels[-1] if labels else None))
            pieces.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal in_link
        in_link -= names[n:].count("a")
        del names[n:], parts[n:], labels[n:]

    def close_within(which: tuple[str, ...], held_by: tuple[str, ...]) -> None:
        for k in range(len(names) - 1, -1, -1):
            if names[k] in which:
                pop_to(k)
                return close_within(which, held_by)
            if names[k] in held_by:
                return None
        return None

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in VOID:
                pieces.append(" ")
                continue
            if name not in INLINE:
                flush()
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                # an inline end tag does not reach over block elements
                if name not in INLINE or all(x in INLINE for x in names[k:]):
                    pop_to(k)
            continue
        if name in RAW:
            if name not in ("svg", "math"):
                flush()
            end = _RAW_END[name].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                pieces.append("" if name == "wbr" else " ")
                continue
        else:
            flush()
            if name in CLOSES_P and "p" in names:
                k = len(names) - 1 - names[::-1].index("p")
                if not any(x in ("td", "th", "button", "caption") for x in names[k:]):
                    pop_to(k)
            if name in CLOSES:
                which, held = CLOSES[name]
                close_within(tuple(which.split()), held)
            if name[0] == "h" and name[1:].isdigit() and names and names[-1][0] == "h" and names[-1][1:].isdigit():
                pop_to(len(names) - 1)
        if name in VOID:
            continue
        attributes = m[3] or m[6] or ""
        around = parts[-1] if parts else ()
        mark = _MARK.search(attributes) if "data-main" in attributes else None
        names.append(name)
        parts.append(around if name in INLINE else around + _own_parts(name, attributes))
        labels.append(int(mark[1]) if mark else labels[-1] if labels else None)
        if name == "a":
            in_link += 1
    flush()
    return out


class _Cells(defaultdict):
    """Hash buckets of strings, remembered for as long as there are few."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        cell = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.n
        if len(self) < 200_000:
            self[word] = cell
        return cell


_path_cells, _word_cells = _Cells(PATH_CELLS), _Cells(WORD_CELLS)


class Features:
    """Of many blocks: buckets of path parts and of words, with the number of each a block, and the measures."""

    def __init__(self, sequence: list[Block]):
        self.path = np.array([_path_cells[p] for b in sequence for p in b.path], np.int64)
        self.path_n = np.array([len(b.path) for b in sequence], np.int64)
        words = [b.text.lower().split() for b in sequence]
        self.words = np.array([_word_cells[w] for ws in words for w in ws], np.int64)
        self.words_n = np.array([len(ws) for ws in words], np.int64)
        self.measures = np.array([self.measured(b, n) for b, n in zip(sequence, self.words_n.tolist(), strict=True)], np.float32).reshape(-1, MEASURES)

    @staticmethod
    def measured(b: Block, words: int) -> tuple[float, ...]:
        ends = min(8, len(_ENDS.findall(b.text[-2000:])))
        return (np.log1p(words) / 4, np.log1p(len(b.text)) / 6, b.linked, ends / 4, float(b.text[-1] in ".!?\"'”»:。！？"), min(2.0, len(b.path) / 10))


def _sums(table: np.ndarray, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the rows of table of each block's cells; a block may have none."""
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    some = n > 0
    if len(cells):
        starts = (np.cumsum(n) - n)[some]
        step = 1 << 20  # cells at a time, in whole blocks
        edges = np.searchsorted(starts, np.arange(0, len(cells) + step, step))
        rows = np.flatnonzero(some)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b:
                upto = starts[b] if b < len(starts) else len(cells)
                out[rows[a:b]] = np.add.reduceat(table[cells[starts[a] : upto]], starts[a:b] - starts[a], axis=0)
    return out


def _scattered(rows: np.ndarray, cells: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The opposite of _sums(): each block's row added to the rows of its cells."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.stack([np.bincount(cells, weights=column[owner], minlength=size) for column in rows.T], axis=1).astype(rows.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLstm:
    """Parameters of each direction: w (inputs, 4H), u (H, 4H), c (4H); path and word tables; output v (2H), a (1)."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 11):
        rng, h, d = np.random.default_rng(seed), hidden, PATH_SIZE + WORD_SIZE + MEASURES
        self.hidden = h
        f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"path": f(0.15, PATH_CELLS, PATH_SIZE), "word": f(0.15, WORD_CELLS, WORD_SIZE), "v": f(0.3, 2 * h), "a": np.zeros(1, np.float32)}
        for side in "fb":
            self.p["w" + side], self.p["u" + side], self.p["c" + side] = f(1 / np.sqrt(d), d, 4 * h), f(1 / np.sqrt(h), h, 4 * h), np.zeros(4 * h, np.float32)
            self.p["c" + side][h : 2 * h] = 1  # remember, to begin with

    def inputs(self, x: Features) -> np.ndarray:
        path = _sums(self.p["path"], x.path, x.path_n)
        word = _sums(self.p["word"], x.words, x.words_n) / np.maximum(x.words_n, 1)[:, None].astype(np.float32)
        return np.concatenate([path, word, x.measures.astype(path.dtype)], axis=1)

    def _walk(self, side: str, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, B, H) of inputs (T, B, D); a sequence's state stays where it has ended."""
        h = self.hidden
        u, given = self.p["u" + side], x @ self.p["w" + side] + self.p["c" + side]
        state, cell = np.zeros((2, x.shape[1], h), given.dtype)
        out, trace = np.empty((len(x), x.shape[1], h), given.dtype), []
        for t in range(len(x)):
            z = given[t] + state @ u
            g = _sigmoid(z[:, : 3 * h])
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            n = np.tanh(z[:, 3 * h :])
            on = live[t][:, None]
            new = np.where(on, f * cell + i * n, cell)
            th = np.tanh(new)
            after = np.where(on, o * th, state)
            if keep:
                trace.append((state, cell, i, f, o, n, th, on))
            state, cell = after, new
            out[t] = state
        return out, trace

    def _layout(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of every (step, sequence), forth and back, and which of them are there."""
        t = np.arange(int(lengths.max()))[:, None]
        live = t < lengths[None]
        starts = np.cumsum(lengths) - lengths
        forth = np.where(live, starts[None] + t, 0)
        back = np.where(live, starts[None] + lengths[None] - 1 - t, 0)
        return forth, back, live

    def logits(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of all blocks, for inputs of sequences one after another."""
        forth, back, live = self._layout(lengths)
        out = np.full(len(x), float(self.p["a"][0]), x.dtype)
        h = self.hidden
        for side, at, v in (("f", forth, self.p["v"][:h]), ("b", back, self.p["v"][h:])):
            states, _ = self._walk(side, x[at], live, False)
            out[at[live]] += (states @ v)[live]
        return out

    def gradient(self, features: Features, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all blocks and its gradient."""
        x, h = self.inputs(features), self.hidden
        forth, back, live = self._layout(lengths)
        logit, walks = np.full(len(x), self.p["a"][0], x.dtype), {}
        for side, at, v in (("f", forth, self.p["v"][:h]), ("b", back, self.p["v"][h:])):
            walks[side] = (at, *self._walk(side, x[at], live, True))
            logit[at[live]] += (walks[side][1] @ v)[live]
        p = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((p - y) / len(y)).astype(x.dtype)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["a"][0] = d.sum()
        dx = np.zeros_like(x)
        for side, (at, states, trace) in walks.items():
            half = slice(0, h) if side == "f" else slice(h, 2 * h)
            dl = np.where(live, d[at], 0)
            grad["v"][half] = np.einsum("tb,tbh->h", dl, states)
            ds, dc = np.zeros_like(states[0]), np.zeros_like(states[0])
            u, dz_all = self.p["u" + side], np.zeros((*at.shape, 4 * h), x.dtype)
            for t in range(len(at) - 1, -1, -1):
                state, cell, i, f, o, n, th, on = trace[t]
                ds = ds + dl[t][:, None] * self.p["v"][half]
                dth = ds * o * on
                dn = dc * on + dth * (1 - th * th)
                dz = np.concatenate([dn * n * i * (1 - i), dn * cell * f * (1 - f), ds * on * th * o * (1 - o), dn * i * (1 - n * n)], axis=1)
                dz_all[t] = dz
                grad["u" + side] += state.T @ dz
                ds = np.where(on, dz @ u.T, ds)
                dc = np.where(on, dn * f, dc)
            flat, rows = dz_all[live], at[live]
            grad["w" + side] = x[rows].T @ flat
            grad["c" + side] = flat.sum(axis=0)
            dx[rows] += flat @ self.p["w" + side].T
        grad["path"] = _scattered(dx[:, :PATH_SIZE], features.path, features.path_n, PATH_CELLS)
        dw = dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(features.words_n, 1)[:, None]
        grad["word"] = _scattered(dw, features.words, features.words_n, WORD_CELLS)
        return loss, grad

    def train(self, pages: list[list[Block]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, dropped: float = DROPPED, seed: int = 5) -> float:
        """Adam over pages of like length, whose blocks all have labels; the mean loss of the last tenth of the steps."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        ready = [(Features(p), np.array([b.label for b in p], np.float32)) for p in sorted(pages, key=len)]
        losses, queue = [], []
        for step in range(1, steps + 1):
            if not queue:  # pages of like length go together, but no length goes on for long
                drawn = np.sort(rng.integers(0, len(ready), 4 * batch))
                queue = [drawn[k : k + batch] for k in rng.permutation(4) * batch]
            some = [ready[k] for k in queue.pop()]
            x = Features([])
            x.path, x.path_n, x.words, x.words_n, x.measures = (np.concatenate([getattr(f, k) for f, _ in some]) for k in ("path", "path_n", "words", "words_n", "measures"))
            keep = rng.random(len(x.path)) >= dropped
            owner = np.repeat(np.arange(len(x.path_n)), x.path_n)[keep]
            x.path, x.path_n = x.path[keep], np.bincount(owner, minlength=len(x.path_n))
            keep = np.repeat(rng.random(len(x.words_n)) >= 0.3, x.words_n)  # of some blocks no word
            owner = np.repeat(np.arange(len(x.words_n)), x.words_n)[keep]
            x.words, x.words_n = x.words[keep], np.bincount(owner, minlength=len(x.words_n))
            loss, grad = self.gradient(x, np.array([len(y) for _, y in some]), np.concatenate([y for _, y in some]))
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grad.values())))))
            for k, g in grad.items():
                first[k] += 0.1 * (g * scale - first[k])
                second[k] += 0.01 * ((g * scale) ** 2 - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def probabilities(self, pages: list[list[Block]], together: int = TOGETHER) -> list[np.ndarray]:
        """Of every block of every page; pages of like length are walked side by side."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= together:
                to += 1
            some = order[at:to]
            lengths = np.array([len(pages[k]) for k in some])
            p = _sigmoid(self.logits(self.inputs(Features([b for k in some for b in pages[k]])), lengths))
            for k, part in zip(some, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = part
            at = to
        return out


#: Path parts that tell of a page's article and of what stands around it, in pages that use them.
_INSIDE, _OUTSIDE = frozenset({"article", "main"}), frozenset({"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "label", ".comment", ".comments", ".ad", ".ads", ".advert", ".cookie", ".sidebar", ".share", ".related", ".newsletter", ".promo", ".menu", ".nav"})


def told(page: list[Block]) -> list[Block] | None:
    """A page's blocks with labels by its own elements; None if it has no article element (or two levels of them)."""
    out = []
    for b in page:
        inside = [p for p in b.path if p in _INSIDE]
        bad = any(p in _OUTSIDE for p in b.path) or ("header" in b.path and not inside)
        out.append(Block(b.text, b.path, b.linked, int(bool(inside) and not bad)))
    return out if any(b.label for b in out) else None


_CONTENT = ("article-body", "content", "post-content", "entry-content", "story", "post", "main-content", "article__text", "text", "body-copy", "blog-post", "page-content")
_WRAPPERS = ("container", "wrapper", "page", "row", "col", "grid", "layout", "inner", "site", "section", "box", "clearfix")
_MENU_WORDS = ("Home", "About", "Contact", "News", "Sport", "Shop", "Login", "Blog", "Products", "Start", "Kontakt", "Accueil", "Inicio", "Archive", "Search", "Help", "Sign up", "Sitemap", "Tags")
_FOOTER_WORDS = ("© 2024 {0}", "All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "© {0} · {1}", "Powered by {0}", "Impressum", "Mentions légales", "Aviso legal")
_NOTICE_WORDS = ("We use cookies to improve your experience. {0}", "This site uses cookies. Accept all", "Please enable JavaScript. {0}", "Subscribe to continue reading. {0}", "Accept", "Reject all", "Cookie settings", "Notice: {0}", "{0}")
_FORM_WORDS = ("Your e-mail", "Name", "Subscribe", "Send", "Search", "Sign up for our newsletter", "Password", "Submit", "Leave a reply", "Message")
_SHARE_WORDS = ("Share", "Tweet", "Like", "Print", "E-mail", "Facebook", "Related: {0}", "Read more", "You may also like", "Most read", "Tags: {0}", "Next post", "Previous post")
_COMMENT_WORDS = ("Comments ({2})", "{2} comments", "Reply", "Posted by {0}", "{0} says:", "Report", "{1}", "{1} {0}", "{1}", "{1}")

_PHRASES = (_MENU_WORDS, _FOOTER_WORDS, _FOOTER_WORDS, _NOTICE_WORDS, _FORM_WORDS, _SHARE_WORDS, _COMMENT_WORDS)


def made_up(sentences: list[str], rng: random.Random) -> str:
    """A page of a random layout whose block elements say what they hold by data-main, texts from the sentences given."""

    def sentence() -> str:
        return html.escape(rng.choice(sentences), quote=False) if sentences else "Text."

    def words(n: int) -> str:
        return " ".join(sentence().split()[:n])

    def filled(phrases: tuple[str, ...]) -> str:
        return rng.choice(phrases).format(words(rng.randrange(1, 4)), sentence(), rng.randrange(1, 90))

    def element(tag: str, inner: str, name: str = "", label: int | None = None) -> str:
        kind = rng.choice(("class", "class", "id"))
        named = f' {kind}="{name}"' if name and rng.random() < 0.85 else ""
        marked = f' data-main="{label}"' if label is not None else ""
        end = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{named}{marked}>{inner}{end}"

    def link(text: str) -> str:
        return f'<a href="/{rng.randrange(999)}">{text}</a>'

    def menu() -> str:
        items = [link(filled(_MENU_WORDS) if rng.random() < 0.5 else words(rng.randrange(1, 3))) for _ in range(rng.randrange(2, 9))]
        style = rng.randrange(3)
        inner = element("ul", "".join(element("li", x) for x in items)) if style == 0 else " | ".join(items) if style == 1 else "".join(element("div", x, "menu-item") for x in items)
        return element(rng.choice(("nav", "nav", "div", "ul")), inner, rng.choice(("nav", "menu", "main-nav", "navbar", "breadcrumbs", "topbar", "toolbar", "pagination")), 0)

    def header() -> str:
        return element(rng.choice(("header", "div")), element(rng.choice(("div", "p", "h1")), words(3), rng.choice(("logo", "site-title", "brand"))) + (element("p", sentence(), "tagline") if rng.random() < 0.5 else ""), rng.choice(("header", "site-header", "masthead", "banner")), 0)

    def footer() -> str:
        inner = "".join(element(rng.choice(("p", "div", "span")), filled(_FOOTER_WORDS) + (" &middot; " + sentence() if rng.random() < 0.5 else "")) for _ in range(rng.randrange(1, 4)))
        return element(rng.choice(("footer", "footer", "div")), inner if rng.random() < 0.6 else "&copy; " + sentence(), rng.choice(("footer", "site-footer", "bottom", "copyright")), 0)

    def advert() -> str:
        return element(rng.choice(("div", "aside", "section")), " ".join(sentence() for _ in range(rng.randrange(1, 3))) if rng.random() < 0.7 else "Advertisement", rng.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad")), 0)

    def notice() -> str:
        return element(rng.choice(("div", "section", "dialog", "aside")), "".join(element(rng.choice(("p", "button", "div")), filled(_NOTICE_WORDS)) for _ in range(rng.randrange(1, 4))), rng.choice(("cookie", "cookie-banner", "notice", "consent", "alert", "popup", "modal", "gdpr")), 0)

    def sidebar() -> str:
        inner = element("h3", words(2)) + "".join(element("li", link(words(4))) for _ in range(rng.randrange(1, 6)))
        return element(rng.choice(("aside", "div")), inner if rng.random() < 0.6 else element("p", sentence()), rng.choice(("sidebar", "side", "widget", "related", "teaser", "rail")), 0)

    def form() -> str:
        return element("form", "".join(element(rng.choice(("label", "button", "p", "div", "option")), filled(_FORM_WORDS)) for _ in range(rng.randrange(1, 5))), rng.choice(("newsletter", "search", "signup", "contact", "")), 0)

    def share() -> str:
        return element(rng.choice(("div", "p", "ul")), " ".join(link(filled(_SHARE_WORDS)) for _ in range(rng.randrange(1, 4))), rng.choice(("share", "social", "tags", "meta", "related", "buttons")), 0)

    def comments() -> str:
        inner = "".join(element(rng.choice(("div", "li", "p", "article")), filled(_COMMENT_WORDS), rng.choice(("comment", "comment-body", "reply"))) for _ in range(rng.randrange(1, 7)))
        return element(rng.choice(("section", "div", "ol")), inner, rng.choice(("comments", "comment-list", "responses", "discussion", "disqus")), 0)

    def paragraph() -> str:
        # what stands around articles stands in some as well
        text = filled(rng.choice(_PHRASES)) if rng.random() < 0.12 else " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 4, 6))))
        if rng.random() < 0.15:
            cut = len(text.split()) // 2
            text = " ".join(text.split()[:cut]) + f" <{rng.choice(('b', 'i', 'em'))}>" + " ".join(text.split()[cut:]) + "<br>"
        if rng.random() < 0.15:
            text += " " + link(words(3))
        return element(rng.choice(("p", "p", "p", "p", "p", "div", "blockquote", "h2", "h3", "li", "pre", "td")) if rng.random() < 0.5 else "p", text)

    # short articles as well: the labels around them are all there is
    body = [element("h1", words(rng.randrange(2, 12)))] if rng.random() < 0.8 else []
    body += [paragraph() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13)))]
    if rng.random() < 0.1:  # one line over and over
        body += [element("p", words(rng.randrange(1, 6)))] * rng.randrange(3, 30)
    if rng.random() < 0.35:
        body.insert(rng.randrange(len(body) + 1), rng.choice((advert, share, form, sidebar))())
    if rng.random() < 0.2:
        body.append(rng.choice((comments, share))())
    main = element(rng.choice(("article", "article", "main", "div", "div", "section")), "".join(body), rng.choice(_CONTENT), 1)
    for _ in range(rng.randrange(3)):
        main = element(rng.choice(("div", "main", "section")), main, rng.choice(_WRAPPERS))
    before = [rng.choice((menu, menu, header, advert, notice, sidebar, form))() for _ in range(rng.choice((0, 1, 1, 2, 3, 4)))]
    after = [rng.choice((footer, footer, comments, sidebar, form, share, advert, notice, menu))() for _ in range(rng.choice((0, 1, 1, 2, 3, 4)))]
    inside = "".join((*before, main, *after))
    if rng.random() < 0.4:
        inside = element("div", inside, rng.choice(_WRAPPERS))
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{inside}" + ("</body></html>" if rng.random() < 0.8 else "")


def shown(page: list[Block]) -> list[Block]:
    """The blocks of a page that are learnt from."""
    return page if len(page) <= FIRST_BLOCKS + LAST_BLOCKS else page[:FIRST_BLOCKS] + page[-LAST_BLOCKS:]


def _parsed(pages: DataFrame) -> DataFrame:
    """k (a hash of the page h) and its blocks that are learnt from, each with its first WORDS_LEARNT words: pages are cut by the
    tasks, so the driver gets a bounded number of words a page."""
    common.ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"text": " ".join(b.text.split(None, WORDS_LEARNT)[:WORDS_LEARNT]), "path": list(b.path), "linked": b.linked} for b in shown(blocks(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.string())), ("linked", pa.float64())])))], ["k", "blocks"])

    return pages.select(F.xxhash64("h").alias("k"), "h").mapInArrow(run, "k bigint, blocks array<struct<text: string, path: array<string>, linked: double>>")


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, made: int = MADE_UP, steps: int = STEPS) -> BlockLstm:
    """A labeller learnt from about `sample` pages, drawn by the hash of their text (of each at most FIRST_BLOCKS and
    LAST_BLOCKS blocks), and from `made` made-up ones. An empty table gives one learnt from made-up pages of stock phrases."""
    known = pages.select(F.col(html_col).alias("h")).where(F.col("h").isNotNull())
    share = sample / max(1, known.count())
    draw = F.pmod(F.xxhash64("h", F.lit(13)), F.lit(1 << 30)) < int(min(1.0, 1.5 * share) * (1 << 30))
    texts = _parsed(known.where(draw)).limit(2 * sample)
    texts = [[Block(b["text"], tuple(b["path"]), b["linked"], None) for b in r["blocks"]] for r in sorted(texts.collect(), key=lambda r: (r["k"], len(r["blocks"])))[:sample]]
    rng = random.Random(29)
    labelled = [x for x in map(told, texts) if x]
    sentences = sorted({s.strip() for t in texts for b in t for s in re.split(r"(?<=[.!?])\s", b.text)[:4] if 3 < len(s) < 400})
    rng.shuffle(sentences)
    stock = ["The quick brown fox jumps over the lazy dog.", "A page has a text of its own.", "Nothing is said of it here, as far as we know.", "Words follow words until there are enough of them."]
    sentences = sentences[:5000] or stock
    labelled += [b for b in (shown(blocks(made_up(sentences, rng))) for _ in range(made)) if b and all(x.label is not None for x in b)]
    model = BlockLstm()
    model.train(labelled, steps)
    return model


def main_text(model: BlockLstm, pages: list[str]) -> list[str]:
    """Blocks of the article of each page, one a line."""
    cut = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, q in zip(c, p.tolist(), strict=True) if q >= 0.5) for c, p in zip(cut, model.probabilities(cut), strict=True)]


def groups(texts: list[str | None], size: int = 4 << 20) -> Iterator[list[str]]:
    """Texts in runs of about `size` characters; null is empty."""
    held: list[str] = []
    total = 0
    for t in texts:
        if held and total + len(t or "") > size:
            yield held
            held, total = [], 0
        held.append(t or "")
        total += len(t or "")
    if held:
        yield held


def extract(pages: DataFrame, model: BlockLstm, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, text (the main text, one block a line; empty if there is none) and n_chars (its code points) of
    every row. A null or empty page has an empty text; repeated rows and null ids come as they are; an empty table gives an empty
    one. Columns in `keep` may have any name but text and n_chars, else ValueError. Map-only: a page is one task's work, read whole
    and with memory in proportion to its length."""
    common.kept(keep, ("text", "n_chars"))
    common.ready(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(model)
    fields = [pages.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += part.num_rows
                done = [t for group in groups(part.column(0).to_pylist()) for t in main_text(weights.value, group)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], [*keep, "text", "n_chars"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "text string, n_chars bigint"
    return pages.select(F.col(html_col), *keep).mapInArrow(run, schema)


def op13_main_text(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


#: For pages with one article element whose blocks are headings and paragraphs, as the given ones have.
ORACLE = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS a FROM pages),
pieces AS (SELECT page_id, url, i, regexp_replace(p[i], '<[^>]*>', ' ', 'g') AS t
           FROM (SELECT page_id, url, regexp_split_to_array(a, '</?(?:h1|p)>') AS p FROM inner_html), range(1, len(p) + 1) r(i)),
decoded AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'),
            '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM pieces),
texts AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text FROM decoded GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
