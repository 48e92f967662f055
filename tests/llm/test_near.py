"""Operators 4 and 6 against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from oracle import same

from logloom import llm
from logloom.llm import components, fingerprints, ngram_join, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, k=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(ids, texts, k=4, percent=85):
    sets = sets_of(texts, k)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), links[i]) for i, s in zip(ids, sets, strict=True)}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()}


def test_shingle_hashes(texts):
    data = [(t or "").encode() for t in texts]
    assert [len(h) for h in shingles.distinct(data, 4)] == [len(s) for s in sets_of(texts)]
    long = " ".join(f"w{i}" for i in range(200_000)).encode()
    alone, beside = list(shingles.distinct([long], 5))[0], list(shingles.distinct([b"a b c d e f", long], 5))[1]
    assert len(long) > 2 * shingles.SLICE and len(alone) == 199_996 and (alone == beside).all()


def test_jaccard(docs, empty, texts):
    ids = [i * 3 for i in range(len(texts))]
    assert result(ngram_join.jaccard_components(docs)) == brute(ids, texts)
    assert result(ngram_join.jaccard_components(empty)) == {}


@pytest.mark.parametrize(("heavy", "block"), [(1, 3), (8, 800)])
def test_jaccard_of_many_near_copies(spark, heavy, block):
    """Sizes from 3 to 400, groups whose links chain, passages that many share; with tiny limits, so that crowded buckets and blocks are used."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (3, 5, 8, 9, 12, 16, 25, 40, 70, 120, 200, 400):
        first = [rng.choice(vocabulary) for _ in range(size)]
        for copies in range(9):
            w = list(first)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            if copies > 6:
                w = w + passage[: size // 8]
            texts.append(" ".join(w))
    texts += [" ".join([rng.choice(vocabulary) for _ in range(rng.choice((4, 10, 30)))] + passage) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert result(ngram_join.jaccard_components(df, heavy=heavy, block=block)) == brute(range(len(texts)), texts)
    assert result(ngram_join.jaccard_components(df, words=5, percent=80, heavy=heavy, block=block)) == brute(range(len(texts)), texts, 5, 80)


def test_jaccard_with_hot_keys(spark, monkeypatch):
    """Keys that the sample calls hot: near copies of one text are most of the rows, and others share passages of them."""
    monkeypatch.setattr(ngram_join, "HOT", 6)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    hot = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(110):
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for n in (10, 25, 60, 100):
        for _ in range(12):
            own = [rng.choice(vocabulary) for _ in range(n)]
            texts += [" ".join(own + hot[:60]), " ".join([*own[:-1], "end", *hot[:60]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for heavy in (4, 16):
        assert result(ngram_join.jaccard_components(df, words=5, percent=80, heavy=heavy)) == brute(range(len(texts)), texts, 5, 80)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        both = rng.integers(0, 2**63, int(rng.integers(0, 300)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64)])) for _ in range(2))
        assert ngram_join.differ(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(np.setxor1d(x, y))
        assert ngram_join.differ(ngram_join.bitmap(x), ngram_join.bitmap(x)) == 0


def test_jaccard_of_repeated_and_null_ids(spark):
    """Every row's text is compared; equal ids connect, null ids do not."""
    rng = random.Random(8)
    x, y, z, v, u = ([f"{c}{rng.randrange(500)}" for _ in range(60)] for c in "xyzvu")
    near = lambda w: " ".join([*w[:-1], "other"])
    x_, y_, z_, v_, u_ = (" ".join(w) for w in (x, y, z, v, u))
    rows = [(5, x_), (5, y_), (3, y_), (9, near(x))]  # class Y has the least id 3, class X is searched all the same
    rows += [(None, z_), (None, near(z)), (30, z_ + " more")]  # null ids near each other and near another
    rows += [(None, v_), (None, near(v))]  # a component without a name
    rows += [(40, u_), (40, u_), (40, u_), (41, near(u)), (50, "alone in its words"), (50, "another lonely set of words"), (None, None), (60, "")]
    sets = sets_of([t for _, t in rows])
    linked = [[i != j and bool(s and t) and 100 * len(s & t) >= 85 * len(s | t) for j, t in enumerate(sets)] for i, s in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if j == i or linked[i][j] or (rows[i][0] is not None and rows[i][0] == rows[j][0])) for i in range(len(rows))]
    names = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    wanted = sorted((str(d), len(sets[i]), str(names[root[i]]), sum(linked[i])) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in ngram_join.jaccard_components(df).collect())
    assert got == wanted


def test_pigeonhole_finds_all_pairs():
    """Two sets within the bound share signatures of the weight that is asked for, whatever the allocation."""
    rng = np.random.default_rng(2)
    cases = ((6, 8, 10), (20, 27, 1000), (100, 139, 10**5), (100, 139, 10**12), (1000, 1399, 10**4))
    for low, high, sets, fine in ((*c, f) for c in cases for f in (False, True)):
        plan = ngram_join.Allocation(low, high, sets, fine=fine)
        for _ in range(30):
            n = int(rng.integers(low, high + 1))
            a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            drop = int(plan.most * 0.5 * rng.random())
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            (ka, ta), (kb, tb) = (ngram_join.signatures(np.unique(x), 3, plan, fine) for x in (a, b))
            found = {k for k, t in zip(ka.tolist(), ta.tolist(), strict=True)} & {k for k, t in zip(kb.tolist(), tb.tolist(), strict=True)}
            assert found


def test_join_oracle(spark):
    same(llm.QUERIES["op6_ngram_join"](spark, "/root/testdata/sf0.001"), llm.ORACLES["op6_ngram_join"], "/root/testdata/sf0.001")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, empty, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    whole = [t or "" for t in texts]
    exact = sets_of(whole, 5)
    for i, t in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        q = len(t) // 4
        edited, r = t[: len(t) - q] + after[:q], got[i * 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == plain[i * 3] == fingerprints.sketches([t])[0].text()
        assert r["edited_fingerprint"] == fingerprints.sketches([edited])[0].text()
        changed = sets_of([edited], 5)[0]
        true = len(exact[i] & changed) / len(exact[i] | changed) if exact[i] | changed else 1.0
        small = len(exact[i]) <= fingerprints.LEAST and len(changed) <= fingerprints.LEAST
        assert r["near_edited"] == pytest.approx(true, abs=1e-9 if small else 0.3)
        assert fingerprints.Sketch.parse(r["fingerprint"]).text() == r["fingerprint"]
    assert fingerprints.edited_likeness(empty).count() == 0


def test_one_document_and_repeated_ids(spark):
    one = fingerprints.edited_likeness(spark.createDataFrame([(7, "a b c d e f g h", 1)], "doc_id long, text string, shard int")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = fingerprints.edited_likeness(spark.createDataFrame([(None, "x y"), (1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in rows) == [(False, 1), (False, 1), (False, 1), (True, 3)]


def test_sketches_of_unequal_documents():
    rng = np.random.default_rng(0)
    large = np.unique(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    small = np.unique(np.concatenate([large[::40][:800], rng.integers(0, 2**64, 200, dtype=np.uint64)]))
    a, b = fingerprints.Sketch.of(small), fingerprints.Sketch.of(large)
    assert a.containment(b) == pytest.approx(0.8, abs=0.12)
    assert fingerprints.Sketch.of(np.union1d(small, large)).text() == a.merged(b).text()


def test_words_that_polynomials_take_for_equal(spark):
    word = lambda n, a, b: "".join(b if i.bit_count() % 2 else a for i in range(n))
    texts = [f"x {word(n, *ab)} y z" for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(ngram_join.jaccard_components(df)) == {i: (1, i, 0) for i in range(len(texts))}
    hashes = [int(h[0]) for h in shingles.distinct([t.encode() for t in texts], 4)]
    assert len(set(hashes)) == len(texts)
    near = [r["near_next"] for r in fingerprints.edited_likeness(df).collect()]
    assert near == [0.0] * len(texts)


def test_sets_of_one_shingle(spark):
    texts = ["a b", "A  b", "a b c", "a a a a", "a a a a a a", "a a a", "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(ngram_join.jaccard_components(df)) == brute(list(range(len(texts))), texts)
