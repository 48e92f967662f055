"""Operators 11 to 13: centroids and runs against brute force, the labeller's gradient and its pages."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import same

from logloom import llm
from logloom.llm import centroids, main_text, periodic_runs

FOLDER = "/root/testdata/sf0.01"


def plain_clusters(rows, clusters, rounds, dims, salt=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centres = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own) if o == k]
            if members:
                centres[k] = [sum(c) // len(members) for c in zip(*members)]
    return sorted(((i if i is not None else -1), k, d) for (i, v) in kept for d, k in [nearest(v)])


@pytest.mark.parametrize("pivots", [0, 3])
def test_centroids(spark, pivots):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) + 3 * (i % 3) for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, []), (None, [0.5] * 4), (306, [0.5] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(3)
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["cluster"], r["distance"]) for r in centroids.cluster(df, 6, 3, 4, pivots=pivots).collect())
    assert got == plain_clusters(rows, 6, 3, 4)


def test_centroids_few_and_none(spark):
    shape = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], shape), dimensions=2).collect() == []
    two = centroids.cluster(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], shape), dimensions=2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in two) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [0.0, 1e30])], shape), dimensions=2).collect()


def test_pivots_rule_out_and_never_change():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (30, 64))
    v = centres[rng.integers(0, 30, 2000)] + rng.integers(-20, 20, (2000, 64))
    centres = np.concatenate([centres, centres[:3]])  # ties
    pivots = centroids.choose_pivots(v[:300])
    who, best, done = centroids.assign(v, centroids.to_pivots(v, pivots), centres, pivots)
    d = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == who).all() and (d.min(axis=1) == best).all()
    assert done < d.size / 5


def test_centroids_oracle(spark):
    same(llm.QUERIES["op11_centroids"](spark, FOLDER), llm.ORACLES["op11_centroids"], FOLDER)


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_automaton():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters = rng.randrange(0, 70), rng.choice((1, 2, 3, 4, 8))
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 8:
                s, q = rng.randrange(n), rng.randrange(1, 8)
                for i in range(s + q, min(n, s + q * rng.randrange(1, 8))):
                    w[i] = w[i - q]
        wanted = plain_runs(w)
        assert periodic_runs.automaton_runs(w) == wanted
        text = [str(x).encode() for x in w]
        assert periodic_runs.runs([text, [], text, [b"a"] * 5]) == [wanted, [], wanted, []]


def test_long_runs():
    unary, period = [b"x"] * 20_000, [str(i).encode() for i in range(3_000)] * 5
    assert periodic_runs.runs([unary, period]) == [[(0, 20_000, 1)], [(0, 15_000, 3_000)]]


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, digest(listing), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(docs, empty, texts, spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.find_runs(docs, edit=True).collect()}
    assert got == {i * 3: plain_row(i * 3, t) for i, t in enumerate(texts) if not t or len(t) < 5000} | {i * 3: got[i * 3] for i, t in enumerate(texts) if t and len(t) >= 5000}
    assert sum(r[0] > 0 for r in got.values()) > 2
    assert periodic_runs.find_runs(empty, edit=True).count() == 0
    odd = spark.createDataFrame([(None, "a a a a a a a b"), (None, None), (None, "a a a a a a a b")], "doc_id long, text string")
    assert sorted((r["n_runs"], r["length"]) for r in periodic_runs.find_runs(odd, edit=True).where("n_runs > 0").collect()) == [(1, 7)] * 2
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs.withColumn("doc_id", docs.text), edit=True)


def test_runs_of_the_table(spark):
    small = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.find_runs(small, edit=True).collect()}
    assert got == {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in small.collect()}
    assert llm.QUERIES["op12_periodic_runs"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def texts_of(page):
    return [b.text for b in main_text.blocks(page)]


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><script>var t='</p>';</script><!-- <p>no</p> --->"
        "<p>one &amp; <b>two</b><br>three<p class=\"a>b\">four &lt;x&gt; caf&eacute; &#8364;<ul><li>five<li>six <a href=/x>link</a></ul>"
        "text\n\t of the&nbsp;body<div>seven</div><textarea>no</textarea><p>eight < nine &unknown; <i>ten"
    )
    assert texts_of(page) == ["one & two three", "four <x> café €", "five", "six link", "text of the body", "seven", "eight < nine &unknown; ten"]
    five = main_text.blocks(page)[3]
    assert five.path[-4:] == ("body", "ul", "li", "leaf li") and 0 < five.linked < 1
    assert [texts_of(x) for x in ("", "plain", "<", "<p", "a<b", "<script>never ends", "<!-- never", "<p title='open>x</p><p>y")] == [[], ["plain"], ["<"], [], ["a"], [], [], ["x", "y"]]
    assert texts_of("<td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl><h1>f<h2>g</h1>h") == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert len(main_text.blocks("<p>x" * 20_000)) == 20_000
    assert len(main_text.blocks("<div>" * 3_000 + "x")[0].path) == 3_001


def test_block_gradient():
    m = main_text.BlockLstm(3)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    rng = random.Random(2)
    pages = [[main_text.Block(f"w{rng.randrange(5)} u{rng.randrange(5)}.", ("p", f".c{rng.randrange(3)}"), 0.3, rng.randrange(2)) for _ in range(n)] for n in (1, 4, 6)]
    x = main_text.Features([b for p in pages for b in p])
    x.measures = x.measures.astype(np.float64)
    lengths, y = np.array([1, 4, 6]), np.array([b.label for p in pages for b in p], np.float64)
    _, grad = m.gradient(x, lengths, y)
    for k, v in m.p.items():
        at = (int({"path": x.path, "word": x.words}[k][0]), 1) if k in ("path", "word") else tuple(rng.randrange(s) for s in v.shape)
        old, e = v[at], 1e-4
        v[at] = old + e
        up = m.gradient(x, lengths, y)[0]
        v[at] = old - e
        down = m.gradient(x, lengths, y)[0]
        v[at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-6), k


@pytest.fixture(scope="module")
def labeller(spark):
    return main_text.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_pages_of_other_layouts(labeller):
    rng = random.Random(12345)
    sentences = ["This line was in no page that was learnt from.", "Nor was that one, of course.", "A short one.", "Somebody wrote these words for the sake of a test, and they go on for a while."]
    pages = [p for p in (main_text.blocks(main_text.made_up(sentences, rng)) for _ in range(300)) if p and all(b.label is not None for b in p)]
    right = [(q >= 0.5) == np.array([b.label for b in p]) for q, p in zip(labeller.probabilities(pages), pages)]
    assert np.mean(np.concatenate(right)) > 0.98 and np.mean([r.all() for r in right]) > 0.9


def test_one_written_page(labeller):
    page = """<html><body><header class="site-header"><a href="/">The Daily</a></header><nav class="main-nav"><a href="/a">Home</a><a href="/b">News</a></nav>
    <div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
    <div class="wrapper"><div class="post-content"><h1>A bridge opens</h1><p>The bridge over the river was opened on Monday, after six years of work.</p>
    <p>It is the longest of its kind in the country, the mayor said.</p></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/x">Ten recipes for soup</a></li></ul></aside></div>
    <section class="comments"><h3>Comments (2)</h3><div class="comment">Ann says: what a fine bridge, I went there today.</div></section>
    <form class="newsletter"><label>Your e-mail</label><button>Subscribe</button></form><footer>&copy; The Daily. All rights reserved.</footer></body></html>"""
    wanted = "A bridge opens\nThe bridge over the river was opened on Monday, after six years of work.\nIt is the longest of its kind in the country, the mayor said."
    assert main_text.main_text(labeller, [page, "", "<nav><a href=/>Home</a></nav>"]) == [wanted, "", ""]
    together = labeller.probabilities([main_text.blocks(page)] * 3 + [main_text.blocks("<p>x")], together=5)
    assert all(np.allclose(together[0], t, atol=1e-5) for t in together[1:3]) and len(together[3]) == 1


def test_main_text_edges(spark, labeller):
    shape = "page_id long, url string, html string, blocks int, k string"
    rows = [(1, "u", None, 1, "k"), (None, None, "", 1, "k"), (2, "u", "<article><p>Words of a page.</p></article>", 1, "k"), (2, "u", "<article><p>Words of a page.</p></article>", 1, "k")]
    rows.append((3, "u", "<nav>Home</nav><article>" + "<p>Some words in a row.</p>" * 30_000 + "</article>", 1, "k"))
    got = main_text.extract(spark.createDataFrame(rows, shape).repartition(2), labeller, keep=("page_id", "blocks", "k")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["blocks"], r["k"]) for r in got) == [(0, 0, 1, "k"), (1, 0, 1, "k"), (2, 16, 1, "k"), (2, 16, 1, "k"), (3, 30_000 * 21 - 1, 1, "k")]
    assert main_text.extract(spark.createDataFrame([], shape), labeller).collect() == []
    with pytest.raises(ValueError):
        main_text.extract(spark.createDataFrame([], shape + ", text string"), labeller, keep=("text",))
    made = main_text.fit(spark.createDataFrame([], shape), made=60, steps=3)
    assert len(made.probabilities([main_text.blocks("<p>x")])[0]) == 1


def test_main_text_oracle(spark):
    same(llm.QUERIES["op13_main_text"](spark, FOLDER), llm.ORACLES["op13_main_text"], FOLDER)
